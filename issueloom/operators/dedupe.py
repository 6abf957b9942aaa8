"""Articles that repeat the same source, title and author count as one."""

from pyspark.sql import Column, DataFrame, functions as F

from issueloom.functions.text import clean_text, duplicate_key


def newest_first(id_column: str = "id") -> Column:
    """A value whose ascending order is newest first, with the id as the last word."""
    return F.struct(
        (-F.unix_micros("published_at")).alias("published"), (-F.unix_micros("first_seen_at")).alias("seen"),
        F.col(id_column).alias("id"))


def effective_articles(articles: DataFrame) -> DataFrame:
    """The newest included article of every duplicate key.

    Winners are found by a partial `min` per key, so a key shared by a third of all rows shrinks to one row
    per map task before the shuffle; bodies travel only in the semi join that follows.
    """
    winners = (
        articles.filter(~F.col("is_excluded"))
        .groupBy(duplicate_key(F.col("source"), F.col("title"), F.col("author")).alias("dup_key"))
        .agg(F.min(newest_first())["id"].alias("id"))
    )
    return articles.filter(~F.col("is_excluded")).join(winners.select("id"), "id", "left_semi")


def effective_members(members: DataFrame, articles: DataFrame) -> DataFrame:
    """(group_id, article_id, source_name, published_at, first_seen_at, order_key) after removing repeats inside each group.

    The narrow article columns only; join bodies back by id where they are needed.
    """
    narrow = articles.filter(~F.col("is_excluded")).select(
        "id", "published_at", "first_seen_at", clean_text(F.col("source")).alias("source_name"),
        F.xxhash64(duplicate_key(F.col("source"), F.col("title"), F.col("author"))).alias("dup_hash"))
    joined = members.join(narrow, F.col("article_id") == F.col("id")).drop("id")
    first = joined.groupBy("group_id", "dup_hash").agg(
        F.min(F.struct(newest_first("article_id").alias("order_key"), "source_name", "published_at", "first_seen_at"))
        .alias("m"))
    return first.select(
        "group_id", F.col("m.order_key.id").alias("article_id"), "m.source_name", "m.published_at", "m.first_seen_at",
        "m.order_key")


def group_sources(effective: DataFrame) -> DataFrame:
    """Distinct source names per group, ignoring case: first spelling, in order of first appearance."""
    firsts = (
        effective.filter(F.col("source_name") != "")
        .groupBy("group_id", F.lower("source_name").alias("source_key"))
        .agg(F.min(F.struct("order_key", "source_name")).alias("first"))
    )
    return firsts.groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list("first")), lambda s: s["source_name"]).alias("sources"))


def effective_counts(groups: DataFrame, effective: DataFrame) -> DataFrame:
    """Per group: articles and distinct sources after duplicate removal; stored values where nothing is left."""
    counted = effective.groupBy("group_id").agg(F.count("*").cast("int").alias("effective_count"))
    stored = F.array_distinct(F.transform("sources", lambda s: F.lower(clean_text(s))))
    return (
        groups.join(counted, "group_id", "left").join(
            group_sources(effective).withColumnRenamed("sources", "found_sources"), "group_id", "left")
        .select(
            *[c for c in groups.columns],
            F.coalesce("effective_count", F.lit(0)).alias("found_articles"),
            F.coalesce("effective_count", "article_count").alias("effective_articles"),
            F.coalesce(F.size("found_sources"), F.size(F.filter(stored, lambda s: s != ""))).alias("effective_sources"),
            F.coalesce("found_sources", F.filter(F.transform("sources", clean_text), lambda s: s != ""))
            .alias("source_names"),
        )
    )
