"""Summaries of changed days against summaries of all days."""

from pyspark.sql import functions as F

from issueloom.operators.grouping import finalize_groups
from issueloom.plans.daily import daily_summaries
from issueloom.plans.incremental import changed_days, day_states, refresh, week_end_of
from issueloom.plans.weekly import weekly_summaries
from issueloom.registry.base import tables
from issueloom.session import materialize
from issueloom.sources.tables import LATIN_CATEGORY_RULES


def said(summaries):
    return sorted(map(tuple, summaries.drop("generated_at").select(
        "date", "headline", "summary", "issue_count", "article_count", "source_count", F.to_json("categories").alias("c"),
        F.to_json("top_issues").alias("i")).collect()))


def test_one_new_article_writes_one_day_and_its_week(spark):
    t = tables(spark, "/root/testdata/sf0.001")
    articles, early, late = materialize(t.articles, "articles"), F.timestamp_seconds(F.lit(1)), F.timestamp_seconds(F.lit(2))

    def grouped(rows):
        members = rows.select(F.sha2(F.lower(F.substring_index("title", " ", 1)), 256).alias("group_id"), F.col("id").alias("article_id"))
        groups, kept = finalize_groups(members, rows, LATIN_CATEGORY_RULES)
        return materialize(groups, "groups"), materialize(kept, "members")

    def whole(groups, members, rows, as_of):
        all_days = daily_summaries(groups, members, rows, as_of)
        ends = all_days.summaries.select(week_end_of(F.to_date("date")).alias("week_end")).distinct()
        weekly = weekly_summaries(ends, all_days.summaries, all_days.issue_articles, as_of)
        all_days.summaries = materialize(all_days.summaries.unionByName(weekly), "all")
        return all_days

    groups, members = grouped(articles)
    stored, states = whole(groups, members, articles, early), materialize(day_states(groups, members, articles), "states")
    same = refresh(groups, members, articles, late, stored, states)
    assert same.days.count() == same.weeks.count() == 0 and said(same.summaries) == said(stored.summaries)
    assert same.summaries.filter(F.col("generated_at") == late).count() == 0

    fresh = articles.limit(1).withColumns({
        "id": F.lit("new"), "title": F.lit("Zzz arrives alone"), "is_excluded": F.lit(False),
        "published_at": F.timestamp_seconds(F.lit(1704067200 + 9 * 86400))})  # a Wednesday
    more = materialize(articles.unionByName(fresh), "more")
    groups, members = grouped(more)
    out = refresh(groups, members, more, late, stored, states)
    assert [str(r.period) for r in out.days.collect()] == ["2024-01-10"] and [str(r.week_end) for r in out.weeks.collect()] == ["2024-01-14"]
    assert {r.date for r in out.summaries.filter(F.col("generated_at") == late).collect()} == {"2024-01-10", "weekly:2024-01-08:2024-01-14"}
    want = whole(groups, members, more, late)
    assert said(out.summaries) == said(want.summaries)
    assert sorted(map(tuple, out.issue_articles.collect())) == sorted(map(tuple, want.issue_articles.collect()))

    # and away again: a day without groups would lose its summary, this one goes back to what it was
    groups, members = grouped(articles)
    back = refresh(groups, members, articles, early, out, out.states)
    assert said(back.summaries) == said(stored.summaries) and back.days.count() == 1


def test_days_that_are_gone_are_changed(spark):
    rows = spark.createDataFrame([(1, 3, 7, 9), (2, 1, 1, 1), (3, 2, 2, 2)], "d int, rows bigint, bits bigint, total int").select(
        F.date_add(F.to_date(F.lit("2024-01-01")), F.col("d")).alias("period"), "rows", "bits", F.col("total").cast("decimal(38,0)").alias("total"))
    after = rows.filter("rows <> 1").withColumn("bits", F.when(F.col("rows") == 2, 5).otherwise(F.col("bits")).cast("bigint"))
    assert sorted(str(r.period) for r in changed_days(rows, after).collect()) == ["2024-01-03", "2024-01-04"]
