"""Sentences for categories that have no stored summary."""

from pyspark.sql import DataFrame, functions as F

from issueloom.functions.narrative import local_category_sentence, local_week_sentence


def _category_numbers(briefs: DataFrame) -> DataFrame:
    order = F.struct((-F.col("impact")).alias("i"), (-F.unix_micros("latest_published_at")).alias("t"), "group_id")
    live = briefs.groupBy("category").agg(F.count("*").alias("issues"), F.min_by("title", order).alias("top_title"))
    sources = briefs.select("category", F.explode(F.filter(F.split("source", ", "), lambda s: s != "")).alias("s")).groupBy(
        "category").agg(F.countDistinct("s").alias("sources"))
    return live.join(sources, "category", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))


def local_category_summary(briefs: DataFrame) -> DataFrame:
    return _category_numbers(briefs).select("category", local_category_sentence(
        F.col("category"), F.col("issues"), F.col("top_title")).alias("summary"))


def local_week_summary(briefs: DataFrame, label: str) -> DataFrame:
    return _category_numbers(briefs).select("category", local_week_sentence(
        F.lit(label), F.col("category"), F.col("issues"), F.col("sources"), F.col("top_title")).alias("summary"))
