"""The public feed: one row per issue group with what a reader sees."""

from pyspark.sql import Column, DataFrame, functions as F

from issueloom.functions.dates import minutes_since
from issueloom.functions.narrative import safe_summary
from issueloom.functions.signals import heat, impact, is_low_value
from issueloom.functions.text import clean_text, is_blank, or_empty, title_keywords
from issueloom.functions.urls import publisher
from issueloom.operators.dedupe import effective_counts, effective_members
from issueloom.operators.keywords import newest_members
from issueloom.schema import ARTICLES
from issueloom.sources.feeds import active_articles
from issueloom.sources.store import recent_groups

FEED_MIN, FEED_MAX, FEED_DEFAULT = 100, 2000, 600
LINKS = 8


def related_links(effective: DataFrame, articles: DataFrame, n: int = LINKS) -> DataFrame:
    """(group_id, related_links): the newest `n` articles of every group as link structs, in order."""
    link = F.struct(
        clean_text(F.col("title")).alias("title"), clean_text(F.col("source")).alias("source"),
        publisher(F.col("feed_url")).alias("publisher"), "feed_url", "url", "image_url", "content_fetch_status",
        clean_text(F.col("content_fetch_error")).alias("content_fetch_error"))
    rows = (newest_members(effective, n).select("group_id", "article_id", "pos")
            .join(articles.withColumnRenamed("id", "article_id"), "article_id").select("group_id", "pos", link.alias("link")))
    return rows.groupBy("group_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda s: s["link"]).alias("related_links"))


def briefs(groups: DataFrame, effective: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """Feed rows of the groups that still have an article. Their article ids stay in `effective`."""
    facts = articles.select(F.col("id").alias("article_id"), clean_text(F.col("summary")).alias("feed_summary"),
                            or_empty(F.col("image_url")).alias("image"), publisher(F.col("feed_url")).alias("publisher"))
    rows = effective.select("group_id", "article_id", "order_key", "published_at").join(facts, "article_id")
    first = rows.groupBy("group_id").agg(
        F.max("published_at").alias("newest"),
        F.min(F.when(F.col("feed_summary") != "", F.struct("order_key", "feed_summary")))["feed_summary"].alias("feed_summary"),
        F.min(F.when(~is_blank(F.col("image")), F.struct("order_key", "image")))["image"].alias("image"))
    publishers = (rows.groupBy("group_id", F.lower("publisher").alias("k")).agg(
        F.min(F.struct("order_key", "publisher")).alias("f")).groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list("f")), lambda s: s["publisher"]).alias("publishers")))
    counted = effective_counts(groups, effective)
    title = clean_text(F.col("representative_title"))
    n, s = F.col("effective_articles"), F.size("source_names")
    score = impact(n, s, is_low_value(title, F.col("source_names")))
    return (
        counted.join(first, "group_id").join(publishers, "group_id").join(related_links(effective, articles), "group_id")
        .select(
            "group_id", title.alias("title"), "category",
            clean_text(F.array_join(F.slice("source_names", 1, 2), ", ")).alias("source"), "publishers",
            minutes_since(F.col("newest"), as_of).alias("minutes"), score.alias("impact"), heat(score).alias("heat"),
            safe_summary(or_empty(F.col("feed_summary")), n, s).alias("summary"), or_empty(F.col("image")).alias("image_url"),
            title_keywords(title).alias("keywords"), n.alias("article_count"), F.col("newest").alias("latest_published_at"),
            "related_links", F.col("latest_published_at").alias("stored_latest"))
    )


def brief_feed(groups: DataFrame, members: DataFrame, articles: DataFrame, feeds: DataFrame, as_of: Column,
               n: int = FEED_DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(briefs, brief articles): the newest `n` groups that have an article from an active source.

    Twice as many groups are read as asked for, since some fall away; both limits are part of the result.
    """
    n = min(max(n, FEED_MIN), FEED_MAX)
    read = recent_groups(groups, n * 2)
    wanted = members.join(F.broadcast(read.select("group_id")), "group_id", "left_semi")  # at most 4,000 ids
    visible = active_articles(articles.select([c for c in ARTICLES.fieldNames() if c not in ("content", "embedding")]), feeds)
    effective = effective_members(wanted, visible)
    rows = briefs(read, effective, visible, as_of)
    feed = rows.orderBy(F.desc("stored_latest"), F.asc("group_id")).limit(n).drop("stored_latest")
    shown = effective.join(feed.select("group_id"), "group_id", "left_semi").select("group_id", "article_id", "order_key")
    return feed, shown
