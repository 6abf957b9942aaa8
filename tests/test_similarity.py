"""Similar pairs with pivots and with blocks that are cut further, against all dot products."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from issueloom.operators import similarity as S

NODES = "window int, id string, rank bigint, vector array<double>"


def clustered(seed, clusters, each, size=32, spread=0.12):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, size))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.repeat(centres, each, axis=0) + spread * r.standard_normal((clusters * each, size))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nodes_of(spark, vectors, window=lambda i: 0):
    return spark.createDataFrame([(window(i), str(i), i + 1, v.tolist()) for i, v in enumerate(vectors)], NODES)


def all_pairs(vectors, threshold, window=lambda i: 0):
    dots = np.round(vectors @ vectors.T, 9)
    return {(i, j) for i, j in zip(*np.nonzero(dots >= threshold)) if j < i and window(i) == window(j)}


def found(pairs):
    rows = [(int(r.later), int(r.earlier)) for r in pairs.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("kind", ["unit", "mixed lengths", "copies"])
def test_pivots_lose_nothing_and_skip_much(spark, monkeypatch, kind):
    vectors = clustered(1, 12, 25, spread=0.06)
    if kind == "mixed lengths":
        vectors = vectors * np.random.default_rng(2).uniform(0, 1.6, len(vectors))[:, None]
        vectors[::17] = 0
    elif kind == "copies":
        vectors = vectors[np.random.default_rng(3).integers(0, 40, 300)]
    want = all_pairs(vectors, 0.78)
    nodes = S.with_blocks(nodes_of(spark, vectors))
    monkeypatch.setattr(S, "CHUNK_ROWS", 20)
    monkeypatch.setattr(S, "TASK_ROWS", 200)
    assert found(S.similar_pairs(nodes, nodes)) == want
    rows, pivots = S.chunked_sides(nodes, nodes, len(vectors))
    pairs = S.meeting_chunks(rows, pivots, 0.78)
    assert pairs.agg(F.max("probes")).first()[0] <= 2 * S.CHUNK_ROWS
    every, still = pairs.agg(F.count("*"), F.count_if("open")).first()
    if kind != "copies":
        assert still < 0.6 * every
    # in one piece, the same pairs
    monkeypatch.undo()
    assert found(S.similar_pairs(nodes, nodes)) == want


def test_pivots_at_thresholds_that_prune_nothing(spark, monkeypatch):
    vectors = clustered(4, 4, 12)
    nodes = S.with_blocks(nodes_of(spark, vectors))
    monkeypatch.setattr(S, "CHUNK_ROWS", 8)
    for threshold in (0.0, -1.5, 1.0):
        assert found(S.similar_pairs(nodes, nodes, threshold)) == all_pairs(vectors, threshold)
    zeros = S.with_blocks(nodes_of(spark, np.zeros((30, 4))))
    assert found(S.similar_pairs(zeros, zeros)) == set()
    none = S.with_blocks(nodes_of(spark, vectors).filter("id = ''"))
    assert found(S.similar_pairs(none, none)) == set()


def test_windows_of_all_sizes_at_once(spark, monkeypatch):
    vectors = clustered(5, 6, 20)
    window = lambda i: 0 if i % 3 else 1 + i // 30
    nodes = S.with_blocks(nodes_of(spark, vectors, window))
    monkeypatch.setattr(S, "CHUNK_ROWS", 15)
    assert found(S.similar_pairs(nodes, nodes, self_join=True)) == all_pairs(vectors, 0.78, window)


def test_crowded_blocks_are_cut_until_they_fit(spark):
    vectors = clustered(6, 10, 60, size=64, spread=0.05)
    want = all_pairs(vectors, 0.78)
    plain = nodes_of(spark, vectors)
    for block_rows in (40,):
        nodes = S.with_blocks(plain, hashed=True, block_rows=block_rows)
        largest = nodes.select(F.explode("blocks").alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
        got = found(S.similar_pairs(nodes, nodes, self_join=True))
        assert largest <= max(block_rows, 0) and got <= want and len(got) >= 0.9 * len(want)


def test_blocks_of_copies_stay_whole_and_are_compared_in_chunks(spark, monkeypatch):
    vectors = np.repeat(clustered(7, 2, 1), 30, axis=0)
    nodes = S.with_blocks(nodes_of(spark, vectors), hashed=True, bands=6, block_rows=10)
    monkeypatch.setattr(S, "CHUNK_ROWS", 10)
    assert found(S.similar_pairs(nodes, nodes, self_join=True)) == all_pairs(vectors, 0.78)


def test_a_chunk_is_sent_once_to_each_tile(spark, monkeypatch):
    vectors = clustered(9, 3, 100, spread=0.15)
    want = all_pairs(vectors, 0.7)
    nodes = S.with_blocks(nodes_of(spark, vectors))
    monkeypatch.setattr(S, "CHUNK_ROWS", 20)
    monkeypatch.setattr(S, "TILES", 2)
    sent, tiled = [], S.tiled
    monkeypatch.setattr(S, "tiled", lambda pairs: sent.append((pairs, tiled(pairs))) or sent[-1][1])
    assert found(S.similar_pairs(nodes, nodes, 0.7)) == want
    (pairs, tiles), = sent
    once_a_pair = pairs.agg(F.sum(F.expr("probes + indexed"))).first()[0]
    assert tiles.agg(F.sum("n")).first()[0] < once_a_pair / 3
    # each open pair is met in one tile
    bits = tiles.filter("side = 0").alias("l").join(tiles.filter("side = 1").alias("r"), ["block", "pt", "it"]).filter(
        "shiftright(l.slot, int(r.slot)) & 1 = 1").select("block", F.col("l.chunk").alias("p"), F.col("r.chunk").alias("i"))
    assert sorted(map(tuple, bits.collect())) == sorted(map(tuple, pairs.select("block", "p", "i").collect()))


def tile(vectors, mask=1, slot=0):
    n = len(vectors)
    whole = lambda v, kind: pa.array([v] * n, kind)
    none = pa.nulls(n, pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict({
        "block": whole(5, pa.int64()), "pt": whole(0, pa.int64()), "it": whole(0, pa.int64()), "side": whole(0, pa.int32()),
        "chunk": whole(0, pa.int64()), "mask": whole(mask, pa.int64()), "slot": whole(slot, pa.int64()), "window": whole(0, pa.int32()),
        "rank": pa.array(range(1, n + 1), pa.int64()), "vector": pa.array(vectors.tolist()), "blocks": none, "bands": none})


def test_what_a_task_holds_does_not_grow_with_the_pairs_it_finds():
    vectors = np.repeat(clustered(10, 1, 1), 3000, axis=0)
    batch, pairs = tile(vectors), 0
    tracemalloc.start()
    for out in S._score_tiles(0.78, True, True, False, None, False)([batch.slice(0, 1000), batch.slice(1000)]):
        assert out.num_rows <= S.ROWS_OUT
        pairs += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == 3000 * 2999 // 2 and peak < 100e6  # the pairs alone are 108 MB as two places and a score


def test_blocks_that_would_compare_more_than_windows_find_the_same_pairs(spark, monkeypatch):
    vectors = clustered(11, 6, 30, size=48, spread=0.1)
    nodes = S.with_blocks(nodes_of(spark, vectors, lambda i: i // 90), hashed=True, bits=4, bands=24, block_rows=40)
    blocks = {int(r.id): set(r.blocks) for r in nodes.select("id", "blocks").collect()}
    near = all_pairs(vectors, 0.3, lambda i: i // 90)
    want = {(i, j) for i, j in near if blocks[i] & blocks[j]}
    assert len(want) < len(near)
    sent, sides = [], S._sides
    monkeypatch.setattr(S, "_sides", lambda *a: sent.append(sides(*a)) or sent[-1])
    assert found(S.similar_pairs(nodes, nodes, 0.3)) == want
    assert sent[0].count() == len(vectors)  # once each, not once a block
    monkeypatch.setattr(S, "CHUNK_ROWS", 12)
    monkeypatch.setattr(S, "SLAB", 40)
    assert found(S.similar_pairs(nodes, nodes, 0.3, self_join=True)) == want
    # blocks of few rows are still compared one by one
    fine = S.with_blocks(nodes_of(spark, vectors, lambda i: i // 90), hashed=True, bits=12, bands=8)
    blocks = {int(r.id): set(r.blocks) for r in fine.select("id", "blocks").collect()}
    assert found(S.similar_pairs(fine, fine, 0.3)) == {(i, j) for i, j in near if blocks[i] & blocks[j]}


def test_rows_of_one_table_are_sent_for_both_sides_at_once(spark, monkeypatch):
    vectors = clustered(12, 3, 60, spread=0.15)
    nodes = S.with_blocks(nodes_of(spark, vectors))
    monkeypatch.setattr(S, "CHUNK_ROWS", 20)
    rows, chunked = [], S.chunked_sides
    monkeypatch.setattr(S, "chunked_sides", lambda *a: rows.append(chunked(*a)) or rows[-1])
    got = S.similar_pairs(nodes, nodes, 0.7, ids=False)
    assert rows[0][0].count() == len(vectors)
    assert sorted((r.later_rank - 1, r.earlier_rank - 1) for r in got.collect()) == sorted(all_pairs(vectors, 0.7))


@pytest.mark.parametrize("chunk_rows", [2000, 15])
def test_only_the_best_pairs_leave_a_task(spark, monkeypatch, chunk_rows):
    vectors = np.round(clustered(13, 3, 40, size=6, spread=0.2), 1)  # ties
    nodes = S.with_blocks(nodes_of(spark, vectors).withColumn("half", F.col("rank") % 2))
    monkeypatch.setattr(S, "CHUNK_ROWS", chunk_rows)
    dots = np.round(vectors @ vectors.T, 9)
    for most, ordered in ((1, True), (2, False)):
        flat = nodes if ordered else nodes.withColumn("rank", F.lit(0).cast("bigint"))
        pairs = S.similar_pairs(flat.filter("half = 0"), flat.filter("half = 1"), 0.78, ordered, most=most).collect()
        got = {}
        for r in pairs:
            got.setdefault(int(r.later), []).append((-r.score, r.earlier_rank, [-ord(c) for c in r.earlier] + [1], int(r.earlier)))
        if chunk_rows == 2000:
            assert max(map(len, got.values())) <= most
        for i in range(1, len(vectors), 2):  # half 0: odd places
            want = sorted((-dots[i, j], j + 1 if ordered else 0, [-ord(c) for c in str(j)] + [1], j)
                          for j in range(0, len(vectors), 2) if dots[i, j] >= 0.78 and (j < i or not ordered))[:most]
            assert [x[3] for x in sorted(got.get(i, []))[:most]] == [x[3] for x in want]


def test_means_are_sums_of_whole_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, None]), ("c", [5.0, 6.0, 9.0]), ("d", []), ("e", None), ("f", [0.5])],
                                    "id string, embedding array<double>")
    members = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c"), ("x", "d"), ("y", "f"), ("z", "e"), ("w", "d")], "group_id string, article_id string")
    means = S.centroids(members, vectors)
    assert {r.group_id: r.vector for r in means.collect()} == {"x": [3.0, 4.0, 9.0], "y": [0.5]}
    assert S.centroids(members, vectors.limit(0)).collect() == []
    assert "explode" not in means._jdf.queryExecution().executedPlan().toString()  # numbers of vectors are not rows
