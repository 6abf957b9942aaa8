"""The partitioned article store: what a batch writes, and what a replay of it gives."""

import os

import pytest
from pyspark.sql import functions as F

from issueloom.registry.base import tables
from issueloom.sources import partitioned as P
from issueloom.sources.store import merge_arrivals, merge_ingest, upsert_articles


def as_of():
    return F.timestamp_seconds(F.lit(1706659200))


def merging(stored, incoming):
    return merge_ingest(stored, incoming, as_of())


def rows(df):
    return sorted((r.id, r.title, r.content, r.first_seen_at, r.updated_at) for r in df.collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


@pytest.fixture()
def store(spark, tmp_path):
    articles = tables(spark, "/root/testdata/sf0.001").articles.drop("doc_id", "lang")
    P.merge_batch(spark, str(tmp_path / "s"), 0, articles, merging)
    return articles, str(tmp_path / "s")


def test_bytes_follow_the_batch(spark, store):
    articles, path = store
    assert rows(P.read_store(spark, path)) == rows(merging(articles.limit(0), articles))
    whole = size(f"{path}/data")
    one = articles.orderBy("first_seen_at", "id").limit(1).withColumn("title", F.lit("new title"))
    P.merge_batch(spark, path, 1, one, merging)
    assert size(f"{path}/data/in_batch=1") < whole / 20
    got = {r.id: r.title for r in P.read_store(spark, path).collect()}
    changed = one.first().id
    assert got[changed] == "new title" and len(got) == articles.count() and sum(t == "new title" for t in got.values()) == 1
    # the replaced partition stays for a replay of this batch, and goes with the next one
    assert rows(P.read_store(spark, path, batch=0)) == rows(merging(articles.limit(0), articles))
    P.merge_batch(spark, path, 2, one.withColumn("title", F.lit("newer")), merging)
    assert P.batches(spark, path) == [1, 2] and size(f"{path}/data") < whole * 1.2
    assert {r.id: r.title for r in P.read_store(spark, path).collect()}[changed] == "newer"


def test_a_replay_gives_equal_rows_and_a_second_merge_changes_nothing(spark, store):
    articles, path = store
    some = articles.filter("is_excluded or title like 'T%'").withColumns({"author": F.lit(""), "content": F.lit("")})
    P.merge_batch(spark, path, 1, some, merging)
    first, parts = rows(P.read_store(spark, path)), P.manifest(spark, path)
    P.merge_batch(spark, path, 1, some, merging)  # as a stream does after a failure
    assert rows(P.read_store(spark, path)) == first and P.manifest(spark, path) == parts
    P.merge_batch(spark, path, 2, some, merging)  # the same items once more
    assert rows(P.read_store(spark, path)) == first
    P.merge_batch(spark, path, 3, some.limit(0), merging)
    assert rows(P.read_store(spark, path)) == first


def test_new_rows_join_the_partition_of_their_day(spark, store):
    articles, path = store
    fresh = articles.limit(3).withColumns({"id": F.concat(F.lit("new"), "id"), "title": F.lit("fresh")}).unionByName(
        articles.limit(1).withColumns({"id": F.lit("undated"), "first_seen_at": F.lit(None).cast("timestamp")}))
    P.merge_batch(spark, path, 1, fresh, merging)
    assert P.read_store(spark, path).count() == articles.count() + 4
    P.merge_batch(spark, path, 2, fresh.withColumn("title", F.lit("again")), upsert_articles_of)
    assert P.read_store(spark, path).filter("title = 'again'").count() == 4


def upsert_articles_of(stored, incoming):
    return upsert_articles(stored, incoming)


def test_a_merge_that_moves_rows_is_refused(spark, store):
    articles, path = store
    with pytest.raises(ValueError):
        P.merge_batch(spark, path, 1, articles.limit(5), lambda stored, new: new.withColumn(
            "first_seen_at", F.col("first_seen_at") + F.expr("INTERVAL 90 DAYS")))
    assert P.batches(spark, path) == [0]


def test_an_empty_store(spark, tmp_path):
    assert P.read_store(spark, str(tmp_path / "none")).count() == 0


def test_merging_twice_is_merging_once(spark):
    articles = tables(spark, "/root/testdata/sf0.001").articles.drop("doc_id", "lang")
    stored, items = articles.filter("author <> ''"), articles.withColumns({"author": F.lit(""), "content": F.lit("x")})
    once = merge_ingest(stored, items, as_of())
    assert rows(merge_ingest(once, items, as_of())) == rows(once)
    assert merge_arrivals(stored, items.limit(7), as_of()).count() == 7


def test_a_run_hands_back_only_what_changed(spark, store):
    from issueloom.functions.dates import korea_date
    from issueloom.plans.pipeline import run_batch
    from issueloom.schema import SUMMARIES, SUMMARY_ARTICLES
    from issueloom.sources.tables import LATIN_CATEGORY_RULES

    articles, path = store
    pages = tables(spark, "/root/testdata/sf0.001").pages.limit(0)
    empty = spark.createDataFrame([], SUMMARIES), spark.createDataFrame([], SUMMARY_ARTICLES)

    def run(incoming, **kind):
        return run_batch(spark, incoming, P.read_store(spark, path), pages, *empty, "2024-01-29 00:00:00+00:00",
                         group_window=korea_date(F.col("published_at")), rules=LATIN_CATEGORY_RULES, **kind)

    first = run(articles.limit(0))
    assert first.changed.count() == first.articles.count() == articles.count()  # all get vectors
    P.merge_batch(spark, path, 1, first.changed, upsert_articles_of)
    new = articles.filter("content_fetch_status <> ''").limit(2).withColumn("title", F.lit("changed"))
    for kind in ({}, {"window_rows": 500}):
        second = run(new, **kind)
        assert {r.id for r in second.changed.collect()} == {r.id for r in new.collect()}
        assert second.articles.count() == articles.count() and second.articles.filter("title = 'changed'").count() == 2
        assert second.articles.filter("embedding is null").count() == 0
        assert second.groups.count() > 0
