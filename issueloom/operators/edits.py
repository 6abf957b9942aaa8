"""Manual corrections, exclusions and external texts laid over stored rows."""

from pyspark.sql import Column, DataFrame, functions as F

from issueloom.functions.text import clean_text, is_blank, strip
from issueloom.operators.dedupe import group_sources, newest_first


def apply_article_edits(articles: DataFrame, edits: DataFrame, as_of: Column) -> DataFrame:
    """Blank title or source and null author, summary or flag keep the stored value; `edits` has one row per id."""
    e = edits.select("id", *[F.col(c).alias(f"_{c}") for c in ("title", "source", "author", "summary", "is_excluded")],
                     F.lit(True).alias("_edited"))
    edited = F.col("_edited").isNotNull()
    new = {
        "title": F.when(~is_blank(F.col("_title")), clean_text(F.col("_title"))).otherwise(F.col("title")),
        "source": F.when(~is_blank(F.col("_source")), clean_text(F.col("_source"))).otherwise(F.col("source")),
        "author": F.when(F.col("_author").isNotNull(), clean_text(F.col("_author"))).otherwise(F.col("author")),
        "summary": F.when(F.col("_summary").isNotNull(), clean_text(F.col("_summary"))).otherwise(F.col("summary")),
        "is_excluded": F.coalesce("_is_excluded", "is_excluded"),
        "updated_at": F.when(edited, as_of).otherwise(F.col("updated_at")),
    }
    return articles.join(e, "id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in articles.columns])


def apply_group_edits(groups: DataFrame, edits: DataFrame) -> DataFrame:
    """Blank category or title and null summary keep the stored value."""
    e = edits.select("group_id", *[F.col(c).alias(f"_{c}") for c in ("category", "representative_title", "summary")])
    new = {
        "category": F.when(~is_blank(F.col("_category")), clean_text(F.col("_category"))).otherwise(F.col("category")),
        "representative_title": F.when(~is_blank(F.col("_representative_title")), clean_text(F.col("_representative_title")))
        .otherwise(F.col("representative_title")),
        "summary": F.when(F.col("_summary").isNotNull(), clean_text(F.col("_summary"))).otherwise(F.col("summary")),
    }
    return groups.join(e, "group_id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in groups.columns])


def relabel_by_article(groups: DataFrame, members: DataFrame, edits: DataFrame) -> DataFrame:
    """A category set on an article goes to the first group that lists it."""
    asked = edits.filter(~is_blank(F.col("category"))).select(F.lower("id").alias("_key"), F.col("category").alias("_new"))
    order = F.struct((-F.unix_micros("latest_published_at")).alias("latest"), "group_id")
    first = (members.select("group_id", F.lower("article_id").alias("_key")).join(asked, "_key")
             .join(groups.select("group_id", "latest_published_at"), "group_id")
             .groupBy("_key", "_new").agg(F.min(order)["group_id"].alias("group_id"))
             .groupBy("group_id").agg(F.max_by("_new", "_key").alias("category")))
    patch = first.select("group_id", "category", F.lit(None).cast("string").alias("representative_title"),
                         F.lit(None).cast("string").alias("summary"))
    return apply_group_edits(groups, patch)


def prune_groups(groups: DataFrame, members: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) without excluded and vanished articles, with counts made anew; emptied groups go."""
    left = members.join(
        articles.filter(~F.col("is_excluded")).select(
            F.col("id").alias("article_id"), "published_at", "first_seen_at", clean_text(F.col("source")).alias("source_name")),
        "article_id").withColumn("order_key", newest_first("article_id"))
    counts = left.groupBy("group_id").agg(F.count("*").cast("int").alias("_n"), F.max("published_at").alias("_latest"))
    fresh = {"article_count": F.col("_n"), "latest_published_at": F.col("_latest"),
             "sources": F.coalesce("_sources", F.array().cast("array<string>"))}
    pruned = (groups.join(counts, "group_id")
              .join(group_sources(left).withColumnRenamed("sources", "_sources"), "group_id", "left")
              .select(*[fresh.get(c, F.col(c)).alias(c) for c in groups.columns]))
    return pruned, left.select("group_id", "article_id")


REPLY = ("headline string, summary string, categories array<struct<category:string,summary:string>>, "
         "topIssues array<struct<title:string,summary:string>>")


def parse_reply(text: Column) -> Column:
    """The first JSON object inside a text writer's answer."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), REPLY)


def merge_reply(summaries: DataFrame, replies: DataFrame, provider: str, as_of: Column) -> DataFrame:
    """Lay replies (date, reply, model) of an external writer over stored summaries; others stay as they are."""
    r = replies.select("date", parse_reply(F.col("reply")).alias("r"), F.col("model").alias("_model"))
    lower = lambda xs, f: F.transform(xs, lambda x: F.lower(x[f]))

    def laid(rows, texts, f):
        usable = F.filter(F.coalesce(texts, F.array().cast(f"array<struct<{f}:string,summary:string>>")),
                          lambda t: ~is_blank(t[f]) & ~is_blank(t["summary"]))
        def one(x, i):
            mine = F.filter(usable, lambda t: F.lower(t[f]) == F.lower(x[f]))
            first = F.array_position(lower(rows, f), F.lower(x[f])) == i + 1
            return x.withField("summary", F.when(first & (F.size(mine) > 0), strip(F.element_at(mine, -1)["summary"]))
                               .otherwise(x["summary"]))
        return F.transform(rows, one)

    has = F.col("r").isNotNull()
    pick = lambda c: F.when(has & ~is_blank(F.col(f"r.{c}")), strip(F.col(f"r.{c}"))).otherwise(F.col(c))
    new = {
        "generated_at": F.when(has, as_of).otherwise(F.col("generated_at")),
        "provider": F.when(has, F.lit(provider)).otherwise(F.col("provider")),
        "model": F.when(has, F.col("_model")).otherwise(F.col("model")), "headline": pick("headline"), "summary": pick("summary"),
        "categories": F.when(has, laid(F.col("categories"), F.col("r.categories"), "category")).otherwise(F.col("categories")),
        "top_issues": F.when(has, laid(F.col("top_issues"), F.col("r.topIssues"), "title")).otherwise(F.col("top_issues")),
    }
    return summaries.join(r, "date", "left").select(*[new.get(c, F.col(c)).alias(c) for c in summaries.columns])
