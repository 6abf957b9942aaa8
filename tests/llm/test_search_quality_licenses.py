import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from issueloom.llm import bpe, decontam, licenses, neardup, pii, quality, topk
from issueloom.llm.batches import flat, slices
from tests.llm.cases import documents, rows_of, tricky_texts, with_clashes, words
from tests.llm.test_bpe import THEIRS


def brute_top(rows, k, every, scale=1024):
    """rows: (vec_id, ints) of the vectors that take part."""
    out = []
    for q, (i, v) in enumerate(rows):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(rows) if c != q)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_exact_top_k(spark, monkeypatch):
    for name, value in (("PACK_BLOCKS", 3), ("PAGE_BLOCKS", 4), ("HAND_PACKS", 1), ("TASK_BLOCKS", 3)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(6)
    rows = [(i, r.normal(0, 0.1, 8).tolist()) for i in range(150)]
    rows += [(150 + i, rows[5][1]) for i in range(30)] + [(200, [0.0] * 8), (-100, rows[1][1]), (300, rows[2][1]), (300, rows[3][1])]
    bad = [(400, None), (500, [1.0, None] + [0.0] * 6), (600, [float("nan")] * 8), (700, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "'clash' as rank", "'clash' as score")
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, topk.exact_top_k(topk.integer_vectors(df), 10, 100, 8).collect())) == brute_top(ints, 10, 100)
    assert sorted(map(tuple, topk.exact_top_k(topk.integer_vectors(df.limit(4)), 10, 2).collect())) == brute_top(ints[:4], 10, 2)
    assert topk.exact_top_k(topk.integer_vectors(df.limit(0))).count() == 0
    # sums beyond 2**53 stay whole numbers
    large = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**20 - 2**-10, 3.0]), (2, [2.0**20 - 2**-10, 3.0])], "vec_id bigint, embedding array<double>")
    got = topk.exact_top_k(topk.integer_vectors(large), 2, 100).collect()
    assert [(g.vec_id, g.score) for g in got] == [(1, 2**30 * (2**30 - 1) + 3 * 2**20), (2, 2**30 * (2**30 - 1) + 3 * 2**20)]


def labelled(n):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = words(i, 150)
        if not good:  # junk in one part of the text only
            w = text.split()
            text = " ".join(w[:70] + [x.upper() + "!!" for x in w[70:110]] + w[110:]) if i % 2 else " ".join(w[:60] + [w[60]] * 60)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled(600)
    table = spark.createDataFrame(labels + [(5, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = with_clashes(documents(spark, rows + tricky_texts()[:4] + [(None, "x")]))
    got = quality.score_documents(docs, table).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    test = [(r.predicted, int(r.doc_id % 3 != 0)) for r in got if r.held_out and (r.doc_id or 0) > 5]
    assert len(test) > 150 and sum(p == y for p, y in test) >= 0.97 * len(test)
    kept = quality.good_documents(docs.withColumn("_quality", F.lit("clash")), table)
    assert {r._quality for r in kept.collect()} == {"clash"}
    kept = kept.drop("_quality")
    assert kept.columns == docs.columns and 350 < kept.count() < 450
    assert {r.score for r in quality.score_documents(docs, table.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), table).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = labelled(90)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    docs, schema = documents(spark, rows), "doc_id bigint, quality int, toxic int"
    a, b = [rows_of(quality.score_documents(docs, spark.createDataFrame(x, schema))) for x in (labels, flipped)]
    assert a == b


def test_features_do_not_depend_on_neighbours():
    texts = ["short clean text", " \n\t " * 50, "", "\n\n      deeply indented " + words(5, 150) + "\n ", "   ", "x", words(6, 64), "\n" * 99 + "last"]
    alone = [quality.passage_features(*flat(pa.array([t])))[0].tolist() for t in texts]
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1), [3, 0, 7, 2, 6, 1, 5, 4], [0, 1, 7, 3, 5, 4, 6, 2]):
        x, passages = quality.passage_features(*flat(pa.array([texts[i] for i in order])))
        parts = np.split(x, np.cumsum(passages)[:-1])
        assert [p.tolist() for p in parts] == [alone[i] for i in order]


def test_gradients():
    model, r = quality.AttentionModel(), np.random.default_rng(2)
    model.p["c"] = r.normal(size=quality.HIDDEN)
    x, passages, y = r.normal(size=(7, quality.FEATURES)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(s := model.scores(x, passages)) + (1 - y) * np.log(1 - s))
    found = model.gradients(model.forward(x, passages), y)
    for name, value in model.p.items():
        at = tuple(0 for _ in value.shape)
        keep, step = value[at], 1e-6
        value[at] = keep + step
        up = loss()
        value[at] = keep - step
        down = loss()
        value[at] = keep
        assert abs((up - down) / (2 * step) - found[name][at]) < 1e-6


def test_increasing_is_longest():
    import itertools
    for values in itertools.product(range(4), repeat=5):
        places = licenses.increasing(list(values))
        got = [values[i] for i in places]
        best = max(n for n in range(6) for c in itertools.combinations(values, n) if all(a < b for a, b in zip(c, c[1:])))
        assert places == sorted(places) and all(a < b for a, b in zip(got, got[1:])) and len(got) == best


def test_alignment_is_increasing_on_both_sides():
    pairs = licenses.align("z a b c d b c e q f".split(), "a b c x d e f".split())
    assert [t for _, t in pairs] == sorted({t for _, t in pairs}) and [a for a, _ in pairs] == sorted({a for a, _ in pairs})
    assert {t for _, t in pairs} >= {0, 4, 5, 6}
    assert licenses.align([], ["a"]) == [] and licenses.align(["a"], []) == []


def test_license_notices(spark):
    mit, apache = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["Apache-2.0"][0]
    changed = " ".join(w for i, w in enumerate(mit.split()) if i % 10)
    rows = tricky_texts() + [(30, words(1, 200) + "\n" + changed.upper()), (31, f"{apache} {words(2, 5)} {apache}"), (31, "é " + apache),
                             (32, "this is licensed to the version of the public"), (33, words(3, 3000) + " Released under the MIT License. x")]
    got = rows_of(licenses.scan(with_clashes(documents(spark, rows))).select("doc_id", "license", "n_matched", "n_template", "first_byte"))
    assert [g[:2] for g in got] == [(30, "MIT"), (31, "Apache-2.0"), (31, "Apache-2.0"), (31, "Apache-2.0"), (33, "MIT")]
    by = {g[0]: g for g in got}
    assert 0.75 * by[30][3] <= by[30][2] < by[30][3] and by[33][2:4] == (5, 5)
    assert sorted(g[4] for g in got if g[0] == 31) == sorted([0, len(f"{apache} {words(2, 5)} "), 3])
    assert licenses.scan(documents(spark, [])).count() == 0


def brute_pipeline(spark, rows, labels, items):
    """The stages one after the other on plain rows; the scores of the first come from the operator's own model."""
    from tests.llm.test_pairs import brute_components
    from tests.llm.cases import shingles
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.train(documents(spark, rows), table)
    good = [r for r in rows if model.scores(*quality.passage_features(*next(slices(pa.array([r[1]], pa.string())))[2:]))[0] >= 0.5]
    sets, roots = brute_components(good)
    least = {}
    for (i, _), root in zip(good, roots):
        least[root] = min(least.get(root, i), i)
    first = [(i, t) for (i, t), root, s in zip(good, roots, sets) if not s or i == least[root]]
    clean = [(i, t) for i, t in first if not any(100 * len(shingles(t) & shingles(x)) >= 75 * len(shingles(x)) for _, x in items)]
    return sorted((i, pii.redact_text(t or ""), THEIRS.encode_ordinary(pii.redact_text(t or ""))) for i, t in clean)


def test_pipeline(spark, tmp_path):
    rows, labels = labelled(240)
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 60, 2)] + [(1100, rows[7][1])]
    items = [(i, words(900 + i, 20)) for i in range(3)]
    rows += [(1200 + i, words(300 + i, 40) + " " + t + " " + words(400 + i, 40)) for i, t in items]
    rows += [(1300, words(500, 50) + " a.b@c.de " + words(501, 50)), (1301, words(502, 40) + " me at host dot org")]
    for name, df in (("documents", documents(spark, rows)), ("benchmark", spark.createDataFrame(items, "item_id bigint, text string")),
                     ("labels", spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))):
        df.coalesce(3).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted((r.doc_id, r.text, list(r.token_ids)) for r in out.collect())
    assert got == brute_pipeline(spark, rows, labels, items)
    assert not {1200, 1201, 1202, 1100} & {g[0] for g in got} and {1300, 1301} <= {g[0] for g in got}


def test_every_stage_bears_an_empty_table_and_keeps_the_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], tricky_texts()):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[:5] == docs.columns and (out.count() > 0) == bool(rows), name


def test_training_takes_whole_texts_within_its_sum(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    rows = [(i, words(i, 64 * (i % 5 + 1))) for i in ids] + [(ids[0], "a second row"), (ids[1], None)]
    docs = documents(spark, rows).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    least = {}
    for i, t in rows:
        least[i] = min(least.get(i, "￿"), t or "")
    sizes = {i: max(1, -(-len(t.split()) // quality.PASSAGE_WORDS)) for i, t in least.items()}
    x, passages, target = quality.training_bags(docs, labels)
    assert passages.tolist() == [sizes[i] for i in sorted(ids)] and len(x) == sum(sizes.values()) and target.tolist() == [i % 2 for i in sorted(ids)]
    x, passages, _ = quality.training_bags(docs, labels, passages=20)
    assert 16 <= passages.sum() == len(x) <= 20 and set(passages) <= set(range(1, 6))
    assert len(quality.training_bags(docs, labels, rows=7)[1]) == 7
