"""Daily and weekly summaries of changed days only.

A day is what its groups and their articles are, so a digest of these tells whether its summary still says what it would say
now. Digests are order-free partial aggregates over narrow hashes, one row a day.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from issueloom.functions.dates import day_key, parse_weekly_key
from issueloom.operators import issues as I
from issueloom.plans.daily import Summaries, daily_summaries
from issueloom.plans.weekly import weekly_summaries
from issueloom.session import materialize

READ_BY_SUMMARIES = ["title", "source", "author", "url", "summary", "content", "is_excluded", "published_at", "first_seen_at"]


def day_states(groups: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """(period, rows, bits, total): a digest of the groups of every day, with the articles in them."""
    placed = I.in_range(groups).select("period", "group_id", F.xxhash64(*sorted(groups.columns)).alias("h"))
    texts = articles.select(F.col("id").alias("article_id"), F.xxhash64(*READ_BY_SUMMARIES).alias("a"))
    linked = (members.select("group_id", "article_id").join(placed.select("period", "group_id"), "group_id").join(texts, "article_id")
              .select("period", F.xxhash64("group_id", "article_id", "a").alias("h")))
    return placed.select("period", "h").unionByName(linked).groupBy("period").agg(
        F.count("*").alias("rows"), F.bit_xor("h").alias("bits"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"))


def changed_days(before: DataFrame, after: DataFrame) -> DataFrame:
    """(period) of the days that are new, gone, or not what they were."""
    same = ["period", "rows", "bits", "total"]
    return after.join(before, same, "left_anti").unionByName(before.join(after, same, "left_anti")).select("period").distinct()


def week_end_of(day: Column) -> Column:
    """The Sunday that ends a day's week."""
    return F.date_add(day, (8 - F.dayofweek(day)) % 7)


@dataclass
class Refreshed:
    """All summaries as they stand now; `states` are what the next refresh starts from, `days` and `weeks` what was written anew."""

    summaries: DataFrame
    issue_articles: DataFrame
    evidence: DataFrame
    states: DataFrame
    days: DataFrame
    weeks: DataFrame


def refresh(groups: DataFrame, members: DataFrame, articles: DataFrame, as_of: Column, stored: Summaries, before: DataFrame) -> Refreshed:
    """Summaries of the days whose groups or articles differ from `before`, and of their weeks; all others stay as stored.

    A day that has no groups any more loses its summary; its week is written again from what is left.
    """
    states = materialize(day_states(groups, members, articles), "day-states")
    days = materialize(changed_days(before, states), "changed-days")
    touched = I.in_range(groups).join(days, "period", "left_semi").drop("period")
    new = daily_summaries(touched, members, articles, as_of)
    keys = days.select(day_key(F.col("period")).alias("date"))
    weeks = days.select(week_end_of(F.col("period")).alias("week_end")).distinct()
    linked = materialize(stored.issue_articles.join(keys, "date", "left_anti").unionByName(new.issue_articles), "summary-articles")
    weekly = F.col("date").startswith("weekly:")
    daily = materialize(stored.summaries.filter(~weekly).join(keys, "date", "left_anti").unionByName(new.summaries), "daily")
    ends = stored.summaries.filter(weekly).withColumn("week_end", parse_weekly_key(F.col("date"))["end"])
    old_weeks = ends.join(weeks, "week_end", "left_anti").select(*stored.summaries.columns)
    new_weeks = weekly_summaries(weeks, daily, linked, as_of)
    evidence = stored.evidence.join(keys, "date", "left_anti").unionByName(new.evidence)
    return Refreshed(materialize(daily.unionByName(old_weeks).unionByName(new_weeks), "summaries"), linked, evidence, states, days, weeks)
