"""The overlap join against a plain comparison of all sets, and the number of candidates it makes."""

import random
from itertools import combinations

import pytest

from issueloom.operators import overlap
from issueloom.operators.overlap import PART_ROWS, meet, overlap_keys
from issueloom.operators.issues import LEGS, rarest_first
from issueloom.session import materialize

NODES = "window int, id string, rank bigint, tokens array<string>, topics array<string>"


def prepared(spark, sets, legs=LEGS, **options):
    rows = [(w, f"{w}-{i}", i + 1, tokens, topics) for w, group in enumerate(sets) for i, (tokens, topics) in enumerate(group)]
    nodes = rarest_first(spark.createDataFrame(rows, NODES))
    return materialize(overlap_keys(nodes, legs, **options), "nodes")


def met(nodes):
    return {(r.window, r.later, r.earlier) for r in meet(nodes, nodes).collect()}


def alike(a, b):
    shared = set(a[0]) & set(b[0])
    return len(shared) >= 4 or sum(len(w) >= 4 for w in shared) >= 2 or bool(set(a[1]) & set(b[1]))


@pytest.mark.parametrize("light", [0, 16])
def test_no_pair_that_shares_enough_is_lost(spark, light):
    r = random.Random(light)
    short, long = [f"s{i}" for i in range(14)], [f"long{i}" for i in range(12)]
    sets = [[(r.sample(short, r.randint(0, 7)) + r.sample(long, r.randint(0, 4)) + [f"own{w}{i}"],
              ["topic"] if r.random() < 0.1 else []) for i in range(90)] for w in range(2)]
    want = {(w, f"{w}-{i}", f"{w}-{j}") for w, group in enumerate(sets) for i, a in enumerate(group) for j, b in enumerate(group)
            if j < i and alike(a, b)}
    found = met(prepared(spark, sets, light=light))
    assert len(want) > 500 and want <= found
    if light == 0:  # extended as far as it pays: most of what is proposed is true
        assert len(found) < 3 * len(want)


def test_frequent_words_alone_make_few_candidates(spark):
    """3,000 issues, every four frequent words at most once together: no two alike, though each word is in 667 of them."""
    pool = [f"w{i}" for i in range(18)]
    chosen = list(combinations(pool, 4))[:3000]
    sets = [[(list(c) + [f"own{i}"], []) for i, c in enumerate(chosen)]]
    assert len(met(prepared(spark, sets))) < 20 * len(chosen)
    # words that all have, and one word more in common
    sets = [[(["a", "b", f"m{i % 3}", f"n{i // 3}", f"o{i}"], []) for i in range(3000)]]
    assert len(met(prepared(spark, sets))) < 20 * 3000
    # two long words, never the same two
    sets = [[([f"long{a}", f"long{b}"], []) for a, b in combinations(range(78), 2)]]
    assert len(met(prepared(spark, sets))) < 20 * 3003


def test_keys_of_many_nodes_are_dealt_to_parts(spark):
    n = 3 * PART_ROWS
    nodes = prepared(spark, [[([], ["t"]) for _ in range(n)]])
    assert {k.parts for r in nodes.limit(5).collect() for k in r.join_keys} == {3}
    first = nodes.filter("rank = 1")
    assert meet(nodes, first).count() == n - 1


def test_sets_without_anything(spark):
    assert met(prepared(spark, [[([], []), (["a"], []), (["a"], [])]])) == set()
    assert prepared(spark, []).count() == 0


@pytest.mark.parametrize("rows", [16, 1024])
def test_common_words_are_counted_and_never_written_out_as_combinations(spark, monkeypatch, rows):
    """400 issues of 16 short words, each word in about 53 of them: pairs, triples and fours of words would be far more rows than words."""
    monkeypatch.setattr(overlap, "TILE_ROWS", rows)
    r = random.Random(5)
    pool = [f"{i}" for i in range(120)]
    sets = [[(r.sample(pool, 16), []) for _ in range(400)] for _ in range(2)]
    nodes = prepared(spark, sets)
    assert all(len(n.join_keys) + max([len(c.tokens) for c in n.crowded], default=0) <= 16 for n in nodes.collect())
    want = {(w, f"{w}-{i}", f"{w}-{j}") for w, group in enumerate(sets) for i, a in enumerate(group) for j, b in enumerate(group)
            if j < i and len(set(a[0]) & set(b[0])) >= 4}
    assert len(want) > 1000 and met(nodes) == want
    # one earlier row is enough to know which rows have any
    probe, index = nodes.filter("rank > 200"), nodes.filter("rank <= 50")
    found = [(p.window, p.later, p.earlier) for p in overlap.crowded_pairs(probe, index, one=True).collect()]
    asked = {(w, x, y) for w, x, y in want if int(x.split("-")[1]) >= 200 and int(y.split("-")[1]) < 50}
    assert set(found) <= asked and {p[:2] for p in found} == {p[:2] for p in asked}
    assert len(found) < len(asked)
