"""Near duplicates, benchmark items, passages and repeated bytes against brute force."""

import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from issueloom.llm import components, decontam, neardup, passages, suffixes
from tests.llm.cases import documents, rows_of, shingles, tricky_texts, with_clashes, word_list, words


def edited(text, seed, share):
    r, out = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(out)), int(share * len(out))):
        out[i] = f"new{seed}x{i}"
    return " ".join(out)


def near_rows():
    base = words(50, 300)
    rows = tricky_texts() + [(100, base)]
    rows += [(100 + i, edited(base, i, 0.004 * (i % 12))) for i in range(1, 60)]  # links of many strengths, chains among them
    rows += [(200 + i, words(60 + i, 80)) for i in range(20)] + [(300, words(61, 80)), (301, words(61, 80).upper())]
    return rows


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (a is b or 100 * len(a & b) >= 75 * len(a | b)):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("chunk", [1024, 7])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = [r for r in near_rows() if r[0] is not None]
    sets, roots = brute_components(rows)
    least = {}
    for (i, _), root, s in zip(rows, roots, sets):
        if s:
            least[root] = min(least.get(root, i), i)
    want = sorted((i, len(s), least[root] if s else i, i == (least[root] if s else i)) for (i, _), root, s in zip(rows, roots, sets))
    got = neardup.near_duplicates(with_clashes(documents(spark, rows)))
    assert sorted(map(tuple, got.collect())) == want


def test_first_of_each(spark):
    rows = near_rows()
    out = neardup.first_of_each(with_clashes(documents(spark, rows)))
    assert {(r._id, r._mark, r.node) for r in out.collect()} == {("clash",) * 3}
    kept = [r.doc_id for r in out.collect()]
    want = {r.doc_id for r in neardup.near_duplicates(documents(spark, rows)).filter("kept and doc_id is not null").collect()}
    assert sorted(i for i in kept if i is not None) == sorted(want) and kept.count(None) == 2
    assert neardup.first_of_each(documents(spark, [])).count() == 0 and neardup.near_duplicates(documents(spark, [])).count() == 0


def test_odd_sketches_estimate_well():
    r = np.random.default_rng(1)
    for shared, own in ((900, 100), (600, 200), (50, 5)):
        every = r.integers(0, 2**64, shared + 2 * own, dtype=np.uint64)
        sets = [np.unique(every[:shared + own]), np.unique(np.append(every[:shared], every[shared + own:]))]
        words_, samples = neardup._odd_sketches(np.concatenate(sets), np.array([0, len(sets[0])]))
        flips = int(np.bitwise_count(words_[0].view(np.uint64) ^ words_[1].view(np.uint64)).sum())
        apart = -neardup.SKETCH_BITS / 2 * np.log(1 - 2 * flips / neardup.SKETCH_BITS)
        estimate = (samples.sum() - apart) / (samples.sum() + apart)
        assert abs(estimate - shared / (shared + 2 * own)) < 0.08


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    got = dict(components.component_roots(spark.createDataFrame(edges, "a int, b int")).collect())
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components.component_roots(spark.createDataFrame([], "a int, b int")).count() == 0


def test_contaminated(spark, monkeypatch):
    items = [(i, words(700 + i, 12 + 4 * i)) for i in range(12)] + [(20, "short one"), (21, None), (22, ""), (23, items_twice := words(5, 20)), (23, items_twice)]
    items += [(None, words(6, 25)), (None, words(7, 9)), (None, None)]
    rows = tricky_texts() + [(50 + i, words(800 + i, 2000) + "\n" + t.upper() + " " + words(900 + i, 50)) for i, t in items[:12]]
    rows += [(70 + i, words(820 + i, 100) + " " + edited(t, i, 0.06) + " x") for i, t in items[:12]]
    rows += [(90, "Short\tone"), (91, "short one more"), (92, words(5, 20)), (92, words(5, 20))]
    rows += [(93, "x " + words(6, 25)), (None, words(7, 9) + " y"), (94, "clean"), (94, words(7, 9))]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    holds = lambda x, t: shingles(t) and 100 * len(shingles(t) & shingles(x)) >= 75 * len(shingles(t))
    want = [(d, i, len(shingles(t)), len(shingles(t) & shingles(x))) for d, x in rows for i, t in items if holds(x, t)]
    clean = sorted(((d, x) for d, x in rows if not any(holds(x, t) for _, t in items)), key=repr)
    docs = with_clashes(documents(spark, rows)).withColumn("_text", F.lit("clash")).withColumn("item_id", F.lit("clash"))
    for block in (decontam.BLOCK_SHINGLES, 40):  # one block or many, the same pairs
        monkeypatch.setattr(decontam, "BLOCK_SHINGLES", block)
        assert rows_of(decontam.contaminated(docs, table)) == sorted(want, key=repr)
        kept = decontam.without_contaminated(docs, table)
        assert kept.columns == docs.columns and rows_of(kept.select("doc_id", "text")) == clean
        assert decontam.without_contaminated(docs, table.limit(0)).count() == len(rows)
    none = spark.createDataFrame([(None, "no item id")], "item_id bigint, text string")
    assert decontam.contaminated(docs.limit(0), none).count() == 0 and decontam.without_contaminated(docs, none).count() == len(rows)
    assert decontam.contaminated(docs, table.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), table).count() == 0


def test_a_sketch_can_not_be_missed():
    for size in range(1, 400):
        assert decontam.sketch_length(size) >= min(size, size - -(-75 * size // 100) + 1)


def test_repeated_passages(spark):
    passage, other = words(11, 60), words(12, 70)
    rows = tricky_texts() + [(30 + i, f"{words(40 + i, 90 + i)} {passage} {words(80 + i, 60)}") for i in range(6)]
    rows += [(40, other), (41, words(90, 33) + " " + edited(other, 1, 0.03)), (42, words(91, 200)), (43, " ".join(passage.split()[:38]) + " " + words(92, 60))]
    got = {r.doc_id: r for r in passages.repeated_passages(with_clashes(documents(spark, rows))).collect()}
    assert {got[30 + i].class_id for i in range(6)} == {30} and got[41].class_id == got[40].class_id == 40
    assert got[4].class_id == got[5].class_id == 4 and not {42, 43, 8, 9} & got.keys()
    for i in range(6):
        start, stop = map(int, got[30 + i].passages.split("-"))
        assert abs(start - 90 - i) <= 8 and abs(stop - 90 - i - 60) <= 8
    assert passages.repeated_passages(documents(spark, [])).count() == 0


def covered_words(row):
    return {w for span in row.passages.split(",") for w in range(*map(int, span.split("-")))} if row else set()


def test_passages_that_stand_twice_in_a_document(spark):
    rows, want = [], {}
    for i in range(20):
        passage, size = words(500 + i, 50 + i), 50 + i
        double = f"{words(600 + i, 80)} {passage} {words(700 + i, 80)} {passage} {words(800 + i, 30)}"
        single = f"{words(900 + i, 40)} {passage}"
        pair = [double, single] if i % 2 else [single, double]
        for doc, text in zip((100 + 2 * i, 101 + 2 * i), pair):
            rows.append((doc, text))
            want[doc] = [(80, 80 + size), (160 + size, 160 + 2 * size)] if text is double else [(40, 40 + size)]
    got = {r.doc_id: r for r in passages.repeated_passages(documents(spark, rows)).collect()}
    for doc, spans in want.items():
        assert {w for a, b in spans for w in range(a, b)} <= covered_words(got.get(doc)), doc


@pytest.mark.parametrize("chunk", [2048, 2])
def test_passages_behind_a_first_document_that_has_only_a_part(spark, monkeypatch, chunk):
    monkeypatch.setattr(passages, "CHUNK", chunk)
    rows, want = [], {}
    for i in range(40):
        passage, base = words(1500 + i, 52), 100 + 10 * i
        line = " ".join(passage.split()[4:46])
        rows += [(base + k, f"{words(2000 + 10 * i + k, 30)} {line} {words(3000 + 10 * i + k, 30)}") for k in range(2)]
        rows += [(base + k, f"{words(2000 + 10 * i + k, 30 + k)} {passage} {words(3000 + 10 * i + k, 30)}") for k in (2, 3, 4)]
        want |= {base + k: set(range(30 + k, 82 + k)) for k in (2, 3, 4)}
    got = {r.doc_id: r for r in passages.repeated_passages(documents(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for doc, all_words in want.items():
        assert len(all_words - covered_words(got[doc])) == 0 and got[doc].class_id == doc // 10 * 10 + 2


def test_short_passages_with_one_word_put_in_left_out_or_changed(spark):
    rows, r = [], random.Random(3)
    for i in range(300):
        passage = words(5000 + i, 50 + i % 11).split()
        middle = len(passage) // 2
        changed = passage[:middle] + ([], ["puttt"] + passage[middle:middle + 1], ["puttt"])[i % 3] + passage[middle + 1:]
        for k, part in enumerate((passage, changed)):
            rows.append((2 * i + k, f"{words(6000 + 2 * i + k, r.randint(20, 60))} {' '.join(part)} {words(8000 + 2 * i + k, 40)}"))
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(documents(spark, rows)).collect()}
    for edit in range(3):
        found = sum(got.get(2 * i) == got.get(2 * i + 1) == 2 * i for i in range(edit, 300, 3))
        print("recall", edit, found)
        assert found >= 99


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    r = np.random.default_rng(8)
    for n in (0, 3, 10, 60, 200):
        values = mixed = r.integers(0, 12 if n == 60 else 2**62, n, dtype=np.uint64) << np.uint64(32)
        ends = np.array([0, n // 3, n])
        got = {(int(o), int(a), int(c), int(b)) for o, a, c, b in zip(*passages.compact_windows(mixed, ends, 5))}
        want = set()
        for row, (low, high) in enumerate(zip(ends[:-1], ends[1:])):
            for c in range(low, high):
                a, b = c, c
                while a > low and values[a - 1] > values[c]:
                    a -= 1
                while b < high - 1 and values[b + 1] >= values[c]:
                    b += 1
                if b - a + 1 >= 5:
                    want.add((row, a, c, b))
        assert got == want


def brute_bytes(rows, length):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for raw in texts:
        for x in range(len(raw) - length + 1):
            seen[raw[x:x + length]] = seen.get(raw[x:x + length], 0) + 1
    out = []
    for (i, _), raw in zip(rows, texts):
        gone = bytearray(len(raw))
        for x in range(len(raw) - length + 1):
            if seen[raw[x:x + length]] > 1:
                gone[x:x + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_bytes(spark):
    block = words(31, 120)[:520]
    rows = tricky_texts() + [(30 + i, f"{words(40 + i, 30)} {block[i * 11:]} {words(60 + i, 25)}") for i in range(9)]
    rows += [(50, block + block), (51, "ab" * 700), (52, "ab" * 300), (53, block[:399]), (54, words(70, 200) + words(70, 200)), (55, "é" * 450)]
    assert rows_of(suffixes.remove_repeats(with_clashes(documents(spark, rows)))) == brute_bytes(rows, suffixes.LENGTH)
    assert suffixes.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("held", [4096, 3, 1])
def test_repeated_bytes_with_many_surroundings_of_one_core(spark, monkeypatch, held):
    monkeypatch.setattr(suffixes, "HELD", held)
    sizes = []
    by_size = suffixes._by_size

    def watched(rows):
        parts = by_size(rows)
        sizes.append([r[0] for r in parts[0].groupBy("lead", "core").count().select("count").collect()])
        return parts

    monkeypatch.setattr(suffixes, "_by_size", watched)
    line, longer = words(31, 200)[:360], words(32, 300)[:700]
    rows = [(i, words(300 + i, 90) + line + words(400 + i, 90)) for i in range(12)]
    rows += [(20 + i, words(500 + i, 80) + longer[10 * i:600 + 10 * i] + words(600 + i, 80)) for i in range(8)]
    rows += [(40, rows[3][1]), (3, rows[3][1])]
    got = [tuple(r) for r in suffixes.remove_repeats(documents(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_bytes(rows, suffixes.LENGTH))
    assert max(sizes[0], default=0) <= held


def test_multikey_order():
    r = np.random.default_rng(3)
    table = r.integers(0, 3, (500, 6), dtype=np.uint64)
    assert [tuple(x) for x in table[suffixes.multikey_order(table)]] == sorted(tuple(x) for x in table)


def test_agreement_of_all_pairs_at_once_is_that_of_each_alone():
    r = np.random.default_rng(5)

    def interval_rows(n):
        low = r.integers(0, 400, n)
        return low, low + r.integers(-3, 40, n), r.integers(0, 3, n), r.integers(0, 6, n), r.integers(0, 30, n)
    low, high, f, group, shift = interval_rows(300)
    near = (np.maximum(low[:, None], low) <= np.minimum(high[:, None], high) + passages.SHIFT) | (
        (low[:, None] <= low) & (low <= high[:, None] + passages.SHIFT)) | ((low <= low[:, None]) & (low[:, None] <= high + passages.SHIFT))
    both = near & (f[:, None] != f) & (group[:, None] == group) & (np.abs(shift[:, None] - shift) <= passages.SHIFT)
    assert passages._meeting(low, high, f, group, shift).tolist() == both.any(axis=1).tolist()


def test_alignments_of_texts_of_few_lines_cover_only_passages():
    r = random.Random(7)
    lines = [[1000 * k + j for j in range(9 + k)] for k in range(1, 8)]
    for _ in range(3):
        lead, other = (np.array(sum((r.choice(lines) for _ in range(15)), []), np.uint64) for _ in range(2))
        other = np.concatenate([other, lead[30:100]])
        lead = np.concatenate([lead, np.arange(50000, 50050, dtype=np.uint64)])
        covered, lead_covered = passages.alignments(passages.Tokens(lead), other, np.arange(len(other)))
        want, lead_want = np.zeros(len(other), bool), np.zeros(len(lead), bool)
        for shift in {p - c for c in range(len(other)) for p in np.flatnonzero(lead == other[c]).tolist()}:
            hit = np.array([other[x] in lead[max(0, x + shift - passages.SHIFT):max(0, x + shift + passages.SHIFT + 1)] for x in range(len(other))])
            for x in range(len(other) - passages.PASSAGE + 1):
                at = np.flatnonzero(hit[x:x + passages.PASSAGE]) + x
                if len(at) >= passages.NEEDED:
                    want[at[0]:at[-1] + 1] = True
                    lead_want[max(0, at[0] + shift):max(0, at[-1] + 1 + shift)] = True
        assert covered[-70:].all() and lead_covered[30:100].all() and not (covered & ~want).any() and not (lead_covered & ~lead_want).any()


def test_equal_surroundings_in_a_text_are_one_row(spark):
    line, odd = words(21, 70), words(22, 60)
    rows = [(1, f"{odd} " + " ".join([line] * 60), [{"key": 5, "place": 66 + 70 * i, "loose": i == 9} for i in range(50)])]
    got = spark.createDataFrame(rows, "doc_id bigint, text string, members array<struct<key: bigint, place: int, loose: boolean>>")
    near = passages.map_texts(got, passages._surroundings, "key bigint, doc_id bigint, place int, loose boolean, near binary").collect()
    assert len(near) == 2 and any(r.loose for r in near)  # the first line stands beside other words
