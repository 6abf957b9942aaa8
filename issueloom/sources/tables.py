"""Views of general-purpose tables as articles and event logs."""

from pyspark.sql import DataFrame, functions as F

ARTICLE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
ARTICLE_SPAN = 2592000  # 30 days

# A small Latin-script rule table for multilingual prose.
LATIN_CATEGORY_RULES = [
    ("world", ["the ", "whou"]),
    ("economy", ["und", "sch", "auf"]),
    ("culture", ["que", "oui", "eaux"]),
    ("society", ["para", "los", "ñ"]),
    ("tech", ["it", "ai"]),
]


def articles_from_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`documents` as an article table; `labels` marks the excluded ones."""
    d = F.col("doc_id")
    toxic = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    published = F.timestamp_seconds(F.lit(ARTICLE_EPOCH) + (d * 7919) % ARTICLE_SPAN)
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    wire = F.concat(F.lit("wire"), (number % 5).cast("string"))
    url = F.concat(F.lit("https://wire.example/"), d.cast("string"))
    return documents.join(toxic, "doc_id", "left").select(
        "doc_id",
        F.sha2(url, 256).alias("id"),
        F.trim(F.substring_index(F.col("text").substr(1, 400), ".", 1)).alias("title"),
        url.alias("url"),
        wire.alias("source"),
        F.when(d % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("desk"), (d % 2).cast("string"))).alias("author"),
        F.concat(F.lit("https://"), wire, F.lit(".example/rss")).alias("feed_url"),
        F.when(d % 7 == 0, F.lit("")).otherwise(F.col("text").substr(1, 300)).alias("summary"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("is_excluded"),
        F.when(d % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("https://img.example/"), d.cast("string"), F.lit(".jpg"))).alias("image_url"),
        F.col("text").alias("content"),
        F.lit(None).cast("timestamp").alias("content_fetched_at"),
        F.when(d % 10 == 0, F.lit("")).when(d % 10 <= 3, F.lit("failed")).otherwise(F.lit("success"))
        .alias("content_fetch_status"),
        F.lit("").alias("content_fetch_error"),
        published.alias("published_at"),
        (published + F.expr("INTERVAL 5 MINUTES")).alias("first_seen_at"),
        (published + F.expr("INTERVAL 10 MINUTES")).alias("updated_at"),
        F.lit(None).cast("array<double>").alias("embedding"),
        "lang",
    )


def events_as_log(events: DataFrame) -> DataFrame:
    """`events` as an operational log. The stored wall clock is UTC."""
    return events.select(
        "event_id",
        F.to_timestamp(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))).alias("created_at"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info")).alias("level"),
        F.col("event_type").alias("type"),
        F.lit("").alias("message"),
        F.col("props").alias("details"),
    )


def create_views(**tables: DataFrame) -> None:
    """Register tables as temporary views, for users who write SQL: create_views(articles=articles, groups=groups)."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
