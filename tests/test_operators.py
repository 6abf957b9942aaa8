"""Hand-computed formulas and brute-force checks on small fixtures."""

import random

import numpy as np
from pyspark.sql import functions as F

from issueloom.functions import dates, signals, text
from issueloom.operators.grouping import group_issues
from issueloom.operators.selection import greedy_select, ordered_select
from issueloom.operators.similarity import similar_pairs, with_blocks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_clean_and_compact(spark):
    assert one(spark, text.clean_text(F.lit("&lt;b&gt;Hi&lt;/b&gt;\r\nyou"))) == "Hi  you"
    assert one(spark, text.clean_text(F.lit("&amp;lt;"))) == "&lt;"
    assert one(spark, text.clean_text(F.lit("&#44032;&#x1F600;&nope;"))) == "가😀&nope;"
    assert one(spark, text.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, text.compact(F.lit("ab cd"), 3)) == "ab..."


def test_scores(spark):
    cases = [(0, 0, 0), (1, 1, 37), (10, 1, 55), (10, 2, 68), (10, 3, 78), (10, 4, 82), (20, 5, 100)]
    rows = spark.createDataFrame(cases, "a int, s int, want int")
    assert rows.filter(signals.impact(F.col("a"), F.col("s")) != F.col("want")).count() == 0
    assert one(spark, signals.rollup_priority(F.lit(3), F.lit(4), F.lit(2), F.lit(63))) == 113
    assert one(spark, signals.selection_score(F.lit(37), F.lit(25), F.lit(1), F.lit(1))) == 63
    assert one(spark, signals.ratio(F.lit(1), F.lit(8))) == 0.12
    assert one(spark, signals.weekly_score(F.lit(60), F.lit(2))) == 65


def test_week_end(spark):
    for day, want in (("2026-06-10", "2026-06-07"), ("2026-06-14", "2026-06-07"), ("2026-06-15", "2026-06-14")):
        assert str(one(spark, dates.week_end(F.lit(day).cast("date")))) == want


def scan(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    kept = set()
    for i in range(n):
        if not near[i] & kept:
            kept.add(i)
    return kept


def test_selection_equals_the_scan(spark, monkeypatch):
    rng = random.Random(5)
    n = 60
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(120)}
    nodes = spark.createDataFrame([(0, str(i), i + 1) for i in range(n)], "window int, id string, rank bigint")
    pairs = spark.createDataFrame([(0, str(a), str(b)) for a, b in edges], "window int, a string, b string")
    want = scan(n, edges)
    assert {int(r.id) for r in ordered_select(nodes, pairs).collect()} == want
    # the same through join rounds only
    monkeypatch.setattr("issueloom.operators.selection.FINISH_EDGES", 0)
    assert {int(r.id) for r in ordered_select(nodes, pairs).collect()} == want


def test_edges_of_ranks_are_gone_through_in_order(spark, monkeypatch):
    from issueloom.operators import selection

    rng = random.Random(6)
    n, windows = 90, 3
    edges = [{tuple(sorted(rng.sample(range(n), 2))) for _ in range(200)} for _ in range(windows)]
    nodes = spark.createDataFrame([(w, f"{w}-{i}", i + 1) for w in range(windows) for i in range(n)], "window int, id string, rank bigint")
    pairs = spark.createDataFrame([(w, max(e) + 1, min(e) + 1) for w in range(windows) for e in edges[w]], "window int, later_rank bigint, earlier_rank bigint")
    want = {f"{w}-{i}" for w in range(windows) for i in scan(n, edges[w])}
    for batch in (10_000, 7):  # edges of a node come in several batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert {r.id for r in ordered_select(nodes, pairs).collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(selection, "FINISH_EDGES", 0)
    assert {r.id for r in ordered_select(nodes, pairs).collect()} == want


def test_batched_selection_on_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 32))
    vectors = np.vstack([b + 0.25 * rng.standard_normal((8, 32)) for b in base])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    order = rng.permutation(len(vectors))
    vectors = vectors[order]
    dots = np.round(vectors @ vectors.T, 9)
    edges = [(i, j) for i in range(len(vectors)) for j in range(i) if dots[i, j] >= 0.78]
    nodes = spark.createDataFrame([(0, str(i), i + 1, v.tolist()) for i, v in enumerate(vectors)],
                                  "window int, id string, rank bigint, vector array<double>")
    want = scan(len(vectors), edges)
    for hashed in (False, True):
        blocked = with_blocks(nodes, hashed)
        found = {(int(r.later), int(r.earlier)) for r in similar_pairs(blocked, blocked, self_join=True).collect()}
        assert found <= set(edges) and len(found) >= 0.95 * len(edges)
        if not hashed:
            kept = greedy_select(blocked, lambda p, i: similar_pairs(p, i), first_batch=16)
            assert found == set(edges) and {int(r.id) for r in kept.collect()} == want
            # several chunks meet: the same pairs
            monkeypatch.setattr("issueloom.operators.similarity.CHUNK_ROWS", 10)
            monkeypatch.setattr("issueloom.operators.similarity.TASK_ROWS", 50)
            assert {(int(r.later), int(r.earlier)) for r in similar_pairs(blocked, blocked).collect()} == set(edges)
            monkeypatch.undo()


def grouped_rows(spark, vectors):
    schema = "id string, is_excluded boolean, published_at timestamp, first_seen_at timestamp, embedding array<double>"
    stamp = F.timestamp_seconds(F.lit(0))
    rows = spark.createDataFrame([(f"a{i:02d}", False, None, None, v) for i, v in enumerate(vectors)], schema)
    rows = rows.withColumns({"published_at": stamp, "first_seen_at": stamp})
    return {r.article_id: r.leader_id for r in group_issues(rows).collect()}


def test_grouping_loses_no_article(spark):
    x, near, far, zero = [1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.0, 0.0]
    assert grouped_rows(spark, []) == {}
    assert grouped_rows(spark, [x]) == {"a00": "a00"}
    assert grouped_rows(spark, [x, x]) == {"a00": "a00", "a01": "a00"}
    assert grouped_rows(spark, [x, near]) == {"a00": "a00", "a01": "a00"}
    assert grouped_rows(spark, [x, far]) == {"a00": "a00", "a01": "a01"}
    assert grouped_rows(spark, [zero] * 4) == {f"a{i:02d}": f"a{i:02d}" for i in range(4)}
    assert grouped_rows(spark, [x, zero, far, x, far, zero]) == {
        "a00": "a00", "a01": "a01", "a02": "a02", "a03": "a00", "a04": "a02", "a05": "a05"}


def test_a_summary_from_outside_survives_the_run(spark):
    from issueloom.functions.dates import korea_date
    from issueloom.plans.pipeline import run_batch
    from issueloom.registry.base import tables
    from issueloom.schema import SUMMARIES, SUMMARY_ARTICLES
    from issueloom.sources.tables import LATIN_CATEGORY_RULES, create_views

    t = tables(spark, "/root/testdata/sf0.001")
    a = t.articles.drop("doc_id", "lang")
    empty = spark.createDataFrame([], SUMMARIES), spark.createDataFrame([], SUMMARY_ARTICLES)

    def run(summaries, links, **kind):
        return run_batch(spark, a.limit(0), a, t.pages.limit(0), summaries, links, "2024-01-29 00:00:00+00:00",
                         group_window=korea_date(F.col("published_at")), rules=LATIN_CATEGORY_RULES, **kind)

    first = run(*empty)
    assert {r.provider for r in first.summaries.collect()} == {"local"} and first.summaries.count() == 2
    given = first.summaries.filter("date not like 'weekly:%'").withColumns({"provider": F.lit("external"), "headline": F.lit("theirs")})
    again = run(given, first.summary_articles)
    create_views(summaries=again.summaries)
    kept = {r.provider: r.headline for r in spark.sql("select * from summaries").collect()}
    assert kept["external"] == "theirs" and set(kept) == {"external", "local"}
    assert sorted(map(tuple, again.summary_articles.collect())) == sorted(map(tuple, first.summary_articles.collect()))


def test_repeated_ids_keep_the_row_updated_last(spark):
    from issueloom.sources.store import upsert_articles

    schema = "id string, title string, updated_at timestamp"
    at = lambda n: F.timestamp_seconds(F.lit(n))
    rows = spark.createDataFrame([("a", "x", None), ("b", "y", None)], schema).withColumn("updated_at", at(0))
    new = rows.filter("id = 'a'").withColumns({"title": F.lit("old"), "updated_at": at(5)}).unionByName(
        rows.filter("id = 'a'").withColumns({"title": F.lit("new"), "updated_at": at(9)}))
    assert {r.id: r.title for r in upsert_articles(rows, new).collect()} == {"a": "new", "b": "y"}


def test_a_topic_of_thousands_makes_few_pairs(spark, monkeypatch):
    from issueloom.operators import issues as I
    from issueloom.rules import TOPIC_RULES

    _, subjects, events = TOPIC_RULES[0]
    n, found, plain = 5000, [], I.similar_issues

    def counted(probe, index):
        edges = plain(probe, index)
        found.append(edges.count())
        return edges
    monkeypatch.setattr(I, "similar_issues", counted)
    rows = spark.range(n).select(
        F.lit("2024-01-01").alias("period"), F.format_string("i%05d", "id").alias("issue_id"),
        F.concat(F.lit(f"{subjects[0]} {events[0]} "), F.sha2(F.col("id").cast("string"), 256)).alias("title"), F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("keywords"), F.lit(False).alias("low"), F.lit(1).alias("parts"),
        F.col("id").cast("int").alias("selection_score"), F.array(F.lit("s")).alias("sources"), F.lit(1).alias("articles"),
        F.timestamp_seconds(F.lit(0)).alias("latest_published_at"))
    assert [r.issue_id for r in I.dedupe_issues(rows).collect()] == [f"i{n - 1:05d}"]
    assert sum(found) <= I.FIRST_ISSUES**2 / 2 + 2 * n


def test_both_sides_of_the_ranking_limit(spark, monkeypatch):
    from issueloom.operators import selection

    rows = spark.createDataFrame([(i % 3, (i * 37) % 101, i) for i in range(300)], "w int, v int, id int")
    want = sorted(map(tuple, selection.rank_rows(rows, "w", [F.asc("v"), F.asc("id")]).select("w", "id", "rank").collect()))
    monkeypatch.setattr(selection, "PLAIN_WINDOW_ROWS", 5)
    assert sorted(map(tuple, selection.rank_rows(rows, "w", [F.asc("v"), F.asc("id")]).select("w", "id", "rank").collect())) == want
