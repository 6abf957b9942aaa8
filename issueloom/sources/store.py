"""Reads and writes of the article, group and summary tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from issueloom.functions.dates import korea_date
from issueloom.functions.text import is_blank
from issueloom.schema import ARTICLES, GROUP_MEMBERS, GROUPS, SUMMARIES, SUMMARY_FILE

WINDOW_DEFAULT, WINDOW_MIN, WINDOW_MAX = 5000, 500, 20000


def by_recency() -> list[Column]:
    return [F.desc("published_at"), F.desc("first_seen_at"), F.asc("id")]


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLES).parquet(path)


def write_articles(articles: DataFrame, path: str) -> None:
    """Articles laid out by Korea day, so a date range reads only its own folders."""
    (articles.withColumn("day", korea_date(F.col("published_at")))
     .repartition("day", F.pmod(F.xxhash64("id"), F.lit(16)))
     .sortWithinPartitions(F.desc("published_at"))
     .write.mode("overwrite").partitionBy("day").parquet(path))


def newest_articles(articles: DataFrame) -> DataFrame:
    return articles.orderBy(*by_recency())


def recent_articles(articles: DataFrame, n: int) -> DataFrame:
    return newest_articles(articles).limit(max(1, n))


def processing_window(articles: DataFrame, n: int = WINDOW_DEFAULT) -> DataFrame:
    """The optional window of newest articles a run may be limited to."""
    return recent_articles(articles, min(max(n, WINDOW_MIN), WINDOW_MAX))


def recent_groups(groups: DataFrame, n: int | None = None) -> DataFrame:
    ordered = groups.orderBy(F.desc("latest_published_at"), F.asc("group_id"))
    return ordered if n is None else ordered.limit(max(1, n))


def articles_by_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles whose id occurs in `ids.article_id`, without body and vector."""
    return articles.drop("content", "embedding").join(
        ids.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")


def missing_content(articles: DataFrame, n: int) -> DataFrame:
    return recent_articles(articles.filter(is_blank(F.col("content_fetch_status"))), n)


def missing_images(articles: DataFrame, n: int) -> DataFrame:
    return recent_articles(articles.filter(is_blank(F.col("image_url"))), n)


def upsert_articles(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` replace rows of `current` with the same id, as a whole; of repeated ids the one updated last stays.

    An anti join lets Spark broadcast the ids of a small batch; a full outer join would shuffle the whole store.
    """
    latest = Window.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.xxhash64(*new.columns))
    new = new.withColumn("_turn", F.row_number().over(latest)).filter("_turn = 1")
    return new.select(*current.columns).unionByName(current.join(new.select("id"), "id", "left_anti"))


KEPT_ON_INGEST = ["first_seen_at", "content", "content_fetched_at", "content_fetch_status", "content_fetch_error"]


def merge_arrivals(stored: DataFrame, incoming: DataFrame, as_of: Column, arrival: Column | None = None,
                   keep_exclusion: bool = False) -> DataFrame:
    """Freshly read items as the articles they become: only rows that arrive.

    A known article keeps its first sighting, body and fetch state, its vector if the item has none, its author
    and image if the item's are blank; everything else comes from the item, the exclusion flag included unless
    `keep_exclusion`. Of several items with one id the last by `arrival` wins.
    """
    columns = stored.columns
    order = arrival if arrival is not None else F.struct("updated_at", "published_at")
    latest = (incoming.select(*columns, order.alias("_arrival")).groupBy("id")
              .agg(F.max(F.struct("_arrival", *[c for c in columns if c != "id"])).alias("_row"))
              .select("id", "_row.*").drop("_arrival"))
    touched = stored.join(latest.select("id"), "id", "left_semi")
    s, n = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"n.{c}"))
    known = s("id").isNotNull()

    def merged(c):
        if c == "updated_at":
            return as_of
        if c in KEPT_ON_INGEST or (c == "is_excluded" and keep_exclusion):
            return F.when(known, s(c)).otherwise(n(c))
        if c == "embedding":
            return F.coalesce(n(c), s(c))
        if c in ("author", "image_url"):
            return F.when(known & is_blank(n(c)), s(c)).otherwise(n(c))
        return n(c)

    return latest.alias("n").join(touched.alias("s"), F.col("s.id") == F.col("n.id"), "left").select(
        *[merged(c).alias(c) for c in columns])


def merge_ingest(stored: DataFrame, incoming: DataFrame, as_of: Column, arrival: Column | None = None,
                 keep_exclusion: bool = False) -> DataFrame:
    """The stored articles with freshly read items merged in (`merge_arrivals`)."""
    arrived = merge_arrivals(stored, incoming, as_of, arrival, keep_exclusion)
    return arrived.unionByName(stored.join(incoming.select("id"), "id", "left_anti"))


def write_groups(groups: DataFrame, members: DataFrame, path: str) -> None:
    """Replace the stored groups and their member lists."""
    groups.select(*GROUPS.fieldNames()).write.mode("overwrite").parquet(f"{path}/groups")
    members.select(*GROUP_MEMBERS.fieldNames()).write.mode("overwrite").parquet(f"{path}/group_members")


def read_groups(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(GROUPS).parquet(f"{path}/groups"),
            spark.read.schema(GROUP_MEMBERS).parquet(f"{path}/group_members"))


def summary_by_key(summaries: DataFrame, key: str) -> DataFrame:
    return summaries.filter(F.col("date") == key)


def newest_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.desc("generated_at"), F.asc("date"))


def upsert_summaries(current: DataFrame, new: DataFrame) -> DataFrame:
    """One row per key: the new row if there is one, else the newest stored row."""
    rest = [c for c in current.columns if c != "date"]
    tagged = current.select(*current.columns).withColumn("_new", F.lit(0)).unionByName(
        new.select(*current.columns).withColumn("_new", F.lit(1)))
    best = tagged.groupBy("date").agg(
        F.max_by(F.struct(*rest), F.struct("_new", "generated_at", F.xxhash64(*rest))).alias("row"))
    return best.select("date", "row.*").select(*current.columns)


def import_summaries(spark: SparkSession, path: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(summaries, their issues' articles) of hand-written files. A file without a date fails the import."""
    raw = spark.read.schema(SUMMARY_FILE).option("multiLine", "true").json(path)
    date = F.when(is_blank(F.col("Date")), F.raise_error(F.lit("Date is required"))).otherwise(F.trim("Date"))
    none = F.array().cast("array<string>")
    issues = F.coalesce(F.transform("TopIssues", lambda i: F.struct(
        i["Title"].alias("title"), i["Category"].alias("category"), i["Summary"].alias("summary"),
        i["ArticleCount"].alias("article_count"), i["Score"].alias("score"),
        F.coalesce(i["Sources"], none).alias("sources"), F.coalesce(i["Keywords"], none).alias("keywords"))),
        F.array().cast(SUMMARIES["top_issues"].dataType))
    summaries = raw.select(
        date.alias("date"), F.coalesce("GeneratedAt", as_of).alias("generated_at"),
        F.when(is_blank(F.col("Provider")), F.lit("manual")).otherwise(F.trim("Provider")).alias("provider"),
        *[F.coalesce(a, F.lit("")).alias(b) for a, b in (("Model", "model"), ("Headline", "headline"), ("Summary", "summary"))],
        *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (
            ("IssueCount", "issue_count"), ("ArticleCount", "article_count"), ("SourceCount", "source_count"))],
        F.coalesce(F.col("Categories").cast(SUMMARIES["categories"].dataType),
                   F.array().cast(SUMMARIES["categories"].dataType)).alias("categories"),
        issues.alias("top_issues"))
    articles = raw.select(date.alias("date"), F.posexplode("TopIssues").alias("i", "issue")).select(
        "date", (F.col("i") + 1).alias("place"), F.explode("issue.ArticleIds").alias("article_id"))
    return summaries, articles


def recent_events(events: DataFrame, n: int, most: int = 200) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(min(max(n, 1), most))
