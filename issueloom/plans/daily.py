"""Daily summaries for every day of a range in one job."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from issueloom.functions import narrative
from issueloom.functions.dates import day_key
from issueloom.operators import issues as I
from issueloom.operators import rollup as R
from issueloom.operators.dedupe import effective_members
from issueloom.operators.keywords import keyword_weights
from issueloom.session import materialize


@dataclass
class DailyIssues:
    """What a day's summary is written from, for all days at once."""

    candidates: DataFrame
    effective: DataFrame
    weights: DataFrame
    merged: DataFrame  # (period, component, group_id)
    issues: DataFrame  # before de-duplication


def daily_candidates(groups: DataFrame, members: DataFrame, articles: DataFrame, start: Column | None = None,
                     end: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, effective members, keyword weights, labelled with period and category) of the days asked for."""
    chosen = materialize(I.in_range(groups, start, end), "groups")
    wanted = members.join(chosen.select("group_id"), "group_id", "left_semi")
    effective = materialize(effective_members(wanted, articles), "effective")
    weights = materialize(keyword_weights(chosen, effective, articles, ("period", "category")), "weights")
    return materialize(I.candidates(chosen, effective, weights), "candidates"), effective, weights


def components_in_turn(candidates: DataFrame, effective: DataFrame, weights: DataFrame) -> DataFrame:
    totals = candidates.groupBy("period").agg(F.count("*").cast("int").alias("total"))
    pairs = R.keyword_pairs(candidates, weights)
    components = materialize(R.pair_components(pairs, totals), "pair-components")
    return R.prioritise(components, R.member_facts(candidates, effective), totals)


def daily_issues(groups: DataFrame, members: DataFrame, articles: DataFrame, start: Column | None = None,
                 end: Column | None = None) -> DailyIssues:
    candidates, effective, weights = daily_candidates(groups, members, articles, start, end)
    merged = materialize(R.select_rollups(components_in_turn(candidates, effective, weights)), "merged")
    united = R.single_issues(candidates, merged).select(*R.ISSUE_COLUMNS).unionByName(
        R.merged_issues(candidates, merged, effective, weights).select(*R.ISSUE_COLUMNS))
    return DailyIssues(candidates, effective, weights, merged, materialize(united, "issues"))


@dataclass
class Summaries:
    """Summaries with nested categories and top issues; the issues' articles and evidence stay flat."""

    summaries: DataFrame
    issue_articles: DataFrame  # (date, place, article_id)
    evidence: DataFrame  # (date, place, pos, title, source, summary, excerpt, url)


def _ordered(structs: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(structs)), lambda s: s["row"])


def daily_summaries(groups: DataFrame, members: DataFrame, articles: DataFrame, as_of: Column,
                    start: Column | None = None, end: Column | None = None) -> Summaries:
    """One summary per Korea day. With both ends given, days without issues get their own row too."""
    d = daily_issues(groups, members, articles, start, end)
    kept = materialize(I.dedupe_issues(d.issues), "kept")
    categories = I.top_categories(d.candidates, d.effective)
    led = materialize(I.category_lead(categories, kept, d.candidates), "categories")
    top = materialize(I.top_issues(kept, led), "top")
    totals = I.period_totals(d.candidates, d.effective)

    category_rows = led.groupBy("period").agg(_ordered(F.struct("place", F.struct(
        "category", "issue_count", "article_count",
        narrative.category_sentence(F.col("lead_title"), F.col("issue_count"), F.col("lead_keywords")).alias("summary"))
        .alias("row"))).alias("categories"))
    issue_rows = top.groupBy("period").agg(_ordered(F.struct("place", F.struct(
        "title", "category", "summary", F.col("articles").alias("article_count"), "score", "sources", "keywords")
        .alias("row"))).alias("top_issues"))
    periods = totals
    if start is not None and end is not None:
        spine = groups.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("period"))
        periods = spine.join(totals, "period", "left").na.fill(0, ["issue_count", "article_count", "source_count"])
    rows = periods.join(category_rows, "period", "left").join(issue_rows, "period", "left")
    for name, like in (("categories", category_rows), ("top_issues", issue_rows)):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(like.schema[name].dataType)))
    names = F.transform("categories", lambda c: c["category"])
    text = F.when(F.col("issue_count") == 0, F.lit(narrative.NO_ISSUES_TEXT)).otherwise(
        narrative.daily_narrative(names, F.get("top_issues", 0)["title"]))
    summaries = rows.select(
        day_key(F.col("period")).alias("date"), as_of.alias("generated_at"), F.lit("local").alias("provider"),
        F.lit("").alias("model"), narrative.daily_headline(F.col("period"), F.col("issue_count")).alias("headline"),
        text.alias("summary"), "issue_count", "article_count", "source_count", "categories", "top_issues")

    placed = top.select("period", "issue_id", "place")
    parts = R.issue_groups(d.candidates, d.merged).join(placed, ["period", "issue_id"])
    issue_articles = parts.join(d.effective.select("group_id", "article_id"), "group_id").select(
        "period", "issue_id", "place", "article_id").distinct()
    shown = I.evidence(issue_articles.select("period", "issue_id", "article_id"), articles).join(
        placed, ["period", "issue_id"])
    key = day_key(F.col("period")).alias("date")
    return Summaries(materialize(summaries, "summaries"), issue_articles.select(key, "place", "article_id"),
                     shown.select(key, "place", "pos", "title", "source", "summary", "excerpt", "url"))
