"""Properties that hold whatever the data."""

from pyspark.sql import functions as F

from issueloom.operators import rollup
from issueloom.operators.dedupe import effective_articles
from issueloom.plans import daily, weekly
from issueloom.registry.base import tables
from issueloom.schema import SUMMARIES, SUMMARY_ARTICLES
from issueloom.session import materialize


def test_removing_repeats_twice_is_removing_them_once(spark):
    articles = tables(spark, "/root/testdata/sf0.001").articles.drop("doc_id", "lang")
    once = materialize(effective_articles(articles), "once")
    twice = effective_articles(once)
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    assert ids(once) == ids(twice) and 0 < once.count() < articles.count()


def test_weeks_without_any_daily_summary(spark):
    weeks = spark.createDataFrame([("2024-01-07",), ("2024-03-03",)], "e string").select(F.to_date("e").alias("week_end"))
    none = spark.createDataFrame([], SUMMARIES), spark.createDataFrame([], SUMMARY_ARTICLES)
    rows = weekly.weekly_summaries(weeks, *none, F.timestamp_seconds(F.lit(0))).collect()
    assert sorted(r.date for r in rows) == ["weekly:2024-01-01:2024-01-07", "weekly:2024-02-26:2024-03-03"]
    assert all(r.issue_count == r.article_count == r.source_count == 0 and r.categories == r.top_issues == [] for r in rows)


def test_rollups_share_no_member_and_need_no_last_task(spark):
    t = tables(spark, "/root/testdata/sf0.01")
    components = materialize(daily.components_in_turn(*t.candidates()), "components")

    def selected(**kind):
        return sorted(map(tuple, rollup.select_rollups(components, **kind).select("period", "component", "group_id").collect()))
    found = selected()
    assert len(found) > 10 and len({(period, group) for period, _, group in found}) == len(found)
    assert selected(finish_rows=0) == found  # all by rounds of joins


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from issueloom.session import shared_folder

    def session(master, warehouse, folder=None):
        known = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": folder}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, *_: known[key]),
                               sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_folder(session("local[8]", "file:/w")) == "file:/w/_issueloom"
    assert shared_folder(session("spark://a:7077", "hdfs://n/w")) == "hdfs://n/w/_issueloom"
    assert shared_folder(session("yarn", "file:/w", "hdfs://n/c")) == "hdfs://n/c"
    for master, warehouse in (("spark://a:7077", "file:/w"), ("local-cluster[3,2,1000]", "/w"), ("yarn", "spark-warehouse")):
        with pytest.raises(ValueError):
            shared_folder(session(master, warehouse))
