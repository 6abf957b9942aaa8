"""Search, sorting, paging and facets of articles and briefs."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from issueloom.functions.dates import korea_date
from issueloom.functions.text import clean_text, is_blank, normalize_title, or_empty, preview, strip
from issueloom.rules import KNOWN_CATEGORIES, UNCATEGORISED
from issueloom.session import materialize

ALL = "전체"


def content_status(status: Column) -> Column:
    return F.when(is_blank(status), F.lit("pending")).otherwise(status)


def article_group(articles: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Articles with `grp`, the struct of the first group that lists them; null when none does."""
    order = F.struct((-F.unix_micros("latest_published_at")).alias("latest"), F.col("group_id").alias("id"))
    fields = F.struct("group_id", "category", "representative_title", "summary", "article_count", "score")
    placed = members.select("group_id", F.lower("article_id").alias("_key")).join(
        groups.select("group_id", order.alias("_order")), "group_id")
    first = placed.groupBy("_key").agg(F.min("_order")["id"].alias("group_id"))
    chosen = first.join(groups.select("group_id", fields.alias("grp")), "group_id").drop("group_id")
    return articles.join(chosen, F.lower("id") == F.col("_key"), "left").drop("_key")


def search_articles(articles: DataFrame, excluded: bool | None = None, category: str = "", source: str = "",
                    status: str = "", text: str = "") -> DataFrame:
    """Articles with `grp` that match every filter given, ignoring case."""
    keep = F.lit(True)
    if excluded is not None:
        keep = keep & (F.col("is_excluded") == excluded)
    if category.strip():
        keep = keep & (F.lower(or_empty(F.col("grp.category"))) == category.lower())
    if source.strip():
        keep = keep & (F.lower(clean_text(F.col("source"))) == source.lower())
    if status.strip():
        keep = keep & (F.lower(content_status(F.col("content_fetch_status"))) == status.lower())
    if text.strip():
        haystack = clean_text(F.concat_ws(" ", "title", "source", "author", "url", "summary", "feed_url"))
        keep = keep & F.lower(haystack).contains(F.lower(clean_text(F.lit(text))))
    return articles.filter(keep)


def article_list_item() -> list[Column]:
    """The list view of an article that carries `grp`."""
    c = F.col
    return [
        c("id"), clean_text(c("title")).alias("title"), clean_text(c("source")).alias("source"),
        clean_text(c("author")).alias("author"), c("url"), c("feed_url"), or_empty(c("grp.group_id")).alias("group_id"),
        F.coalesce(c("grp.category"), F.lit(UNCATEGORISED)).alias("category"), c("is_excluded"), c("published_at"),
        c("updated_at"), content_status(c("content_fetch_status")).alias("content_fetch_status"),
        clean_text(c("content_fetch_error")).alias("content_fetch_error"), (~is_blank(c("content"))).alias("has_content"),
        (~is_blank(c("image_url"))).alias("has_image"), preview(c("summary"), 180).alias("summary_preview"),
        preview(c("content"), 220).alias("content_preview"),
    ]


def article_detail() -> list[Column]:
    c = F.col
    shown = F.when(c("grp").isNotNull(), F.struct(
        c("grp.group_id").alias("id"), c("grp.category"), clean_text(c("grp.representative_title")).alias("title"),
        clean_text(c("grp.summary")).alias("summary"), c("grp.article_count"), c("grp.score")))
    return [
        c("id"), clean_text(c("title")).alias("title"), clean_text(c("source")).alias("source"),
        clean_text(c("author")).alias("author"), c("url"), c("feed_url"), or_empty(c("grp.group_id")).alias("group_id"),
        F.coalesce(c("grp.category"), F.lit(UNCATEGORISED)).alias("category"), c("is_excluded"),
        clean_text(c("summary")).alias("summary"), clean_text(c("content")).alias("content"), c("image_url"),
        c("published_at"), c("first_seen_at"), c("updated_at"), c("content_fetched_at"),
        content_status(c("content_fetch_status")).alias("content_fetch_status"),
        clean_text(c("content_fetch_error")).alias("content_fetch_error"), shown.alias("grp"),
    ]


SHALLOW_ROWS = 10_000  # a page that ends before this is what a bounded top list gives
SLICE_ROWS = 1_000_000


def ranks_between(df: DataFrame, order: list[Column], key: list[str], by: list[str], low: int, high: int, total: int,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of `df` that stand at places low .. high - 1 in `order`, which must be total, given its number of rows.

    Keys alone are dealt to ranges of about `slice_rows` rows, split by a sample of them; the ranges are counted, and only those
    that the places fall into are put in order. `by` names the columns that `order` reads and `key` the ones that tell rows apart.
    """
    count = max(1, -(-total // slice_rows))
    columns = list(dict.fromkeys([*by, *key]))
    sliced = materialize(df.select(*columns).repartitionByRange(count, *order).withColumn("_slice", F.spark_partition_id()), "page-slices")
    sizes = sorted((r["_slice"], r["count"]) for r in sliced.groupBy("_slice").count().collect())  # a row a range
    wanted, before, seen = [], 0, 0
    for number, size in sizes:
        if seen < high and low < seen + size:
            before = before if wanted else seen
            wanted.append(number)
        seen += size
    chosen = sliced.filter(F.col("_slice").isin(wanted)).orderBy(*order).offset(low - before).limit(high - low)
    return df.join(F.broadcast(chosen.select(*key)), key, "left_semi").orderBy(*order)  # a page of keys


def paginate(df: DataFrame, order: list[Column], page: int, size: int, least: int = 10, most: int = 100,
             key: list[str] | None = None, by: list[str] | None = None, shallow: int = SHALLOW_ROWS,
             slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, dict]:
    """One page and its numbers. A page past the end is the last page; `order` must be total.

    With `key`, the columns that tell rows apart, and `by`, those that `order` reads, a page behind the first `shallow` rows is
    found by counting ranges (`ranks_between`).
    """
    size = min(max(size, least), most)
    total = df.count()
    pages = max(1, -(-total // size))
    page = min(max(page, 1), pages)
    low, high = (page - 1) * size, min(page * size, total)
    if key is None or high <= shallow:
        rows = df.orderBy(*order).offset(low).limit(size)
    else:
        rows = ranks_between(df, order, key, by or df.columns, low, high, total, slice_rows)
    return rows, {"page": page, "page_size": size, "page_count": pages, "total_count": total}


def link_texts() -> Column:
    return F.array_join(F.transform("related_links", lambda l: F.concat_ws(
        " ", l["title"], l["source"], or_empty(l["publisher"]))), " ")


def publisher_names() -> Column:
    """Publishers of a brief and of its links, each once."""
    named = F.concat("publishers", F.transform("related_links", lambda l: l["publisher"]))
    return F.array_distinct(F.filter(F.transform(named, lambda p: strip(or_empty(p))), lambda p: p != ""))


def source_names() -> Column:
    """Source names of a brief and of its links; a comma separates several."""
    named = F.concat(F.array(or_empty(F.col("source"))), F.transform("related_links", lambda l: or_empty(l["source"])))
    parts = F.flatten(F.transform(named, lambda s: F.split(s, ",")))
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda s: s != ""))


def in_date_preset(preset: str, as_of: Column) -> Column:
    """`today` and `yesterday` are Korea days; `week` is the last 168 hours."""
    day, today = korea_date(F.col("latest_published_at")), korea_date(as_of)
    return {
        "all": F.lit(True), "today": day == today, "yesterday": day == F.date_sub(today, 1),
        "week": F.col("latest_published_at") >= as_of - F.expr("INTERVAL 168 HOURS"),
    }[preset]


def search_briefs(briefs: DataFrame, as_of: Column, category: str = ALL, text: str = "", preset: str = "all",
                  publisher: str = "all", min_articles: int = 0) -> DataFrame:
    """Briefs that match every filter given; text looks at all that a card shows, ignoring case."""
    keep = in_date_preset(preset, as_of)
    if category != ALL:
        keep = keep & (F.col("category") == category)
    if text.strip():
        shown = F.concat_ws(" ", "title", "category", "source", F.array_join(publisher_names(), " "), "summary",
                            link_texts(), F.array_join("keywords", " "))
        keep = keep & F.lower(shown).contains(text.strip().lower())
    if publisher != "all":
        keep = keep & F.array_contains(publisher_names(), publisher)
    if min_articles:
        keep = keep & (F.col("article_count") >= min_articles)
    return briefs.filter(keep)


def brief_order(mode: str = "latest") -> list[Column]:
    """Sort keys of a feed view; the group id makes every order total."""
    newest, heavy = F.desc("latest_published_at"), F.desc("impact")
    keys = {
        "latest": [newest, heavy], "oldest": [F.asc("latest_published_at")],
        "impact_desc": [heavy, newest], "impact_asc": [F.asc("impact"), newest],
        "articles_desc": [F.desc("article_count"), heavy, newest], "articles_asc": [F.asc("article_count"), newest],
        "title": [F.collate("title", "ko").asc(), newest],
    }[mode]
    return keys + [F.asc("group_id")]


def top_briefs(briefs: DataFrame, n: int = 4) -> DataFrame:
    """The `n` weightiest briefs of every category, newest first on a tie, numbered in `place`."""
    order = Window.partitionBy("category").orderBy(F.desc("impact"), F.desc("latest_published_at"), F.asc("group_id"))
    return briefs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def distinct_ci(df: DataFrame, value: str, order: Column, key: list[str] | None = None) -> DataFrame:
    """Distinct values ignoring case, per `key`: the first spelling, with the order it came in."""
    key = key or []
    firsts = df.filter(~is_blank(F.col(value))).groupBy(*key, F.lower(value).alias("_k")).agg(
        F.min(F.struct(order.alias("first_order"), F.col(value).alias(value))).alias("f"))
    return firsts.select(*key, f"f.{value}", "f.first_order")


def category_facet(groups: DataFrame) -> DataFrame:
    known = groups.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, KNOWN_CATEGORIES))).alias("category"))
    both = groups.select("category").distinct().unionByName(known).filter(~is_blank(F.col("category")))
    return both.groupBy(F.lower("category").alias("k")).agg(F.min("category").alias("category")).select("category").orderBy(
        F.lower("category"))


def source_facet(articles: DataFrame) -> DataFrame:
    names = articles.select(clean_text(F.col("source")).alias("source")).filter("source <> ''")
    return names.groupBy(F.lower("source").alias("k")).agg(F.min("source").alias("source")).select("source").orderBy(
        F.lower("source"))


def publisher_facet(briefs: DataFrame) -> DataFrame:
    return briefs.select(F.explode(publisher_names()).alias("publisher")).distinct().orderBy("publisher")


def source_name_facet(briefs: DataFrame) -> DataFrame:
    return briefs.select(F.explode(source_names()).alias("source")).distinct().orderBy("source")


def today_keywords(briefs: DataFrame, as_of: Column, n: int = 16, min_issues: int = 5, min_sources: int = 3) -> DataFrame:
    """(keyword, issues, sources): keywords of today's issues that enough issues and sources name."""
    today = briefs.filter(in_date_preset("today", as_of)).withColumns(
        {"_names": source_names(), "_title": normalize_title(F.col("title"))})
    first = today.groupBy("source", "_title").agg(F.min_by(
        F.struct("keywords", "_names"), F.struct((-F.unix_micros("latest_published_at")).alias("t"), "group_id")).alias("b"))
    words = first.select("b._names", F.explode(F.array_distinct(F.filter(F.transform(
        "b.keywords", lambda k: strip(F.regexp_replace(k, "^#", ""))), lambda k: k != ""))).alias("keyword"))
    issues = words.groupBy("keyword").agg(F.count("*").alias("issues"))
    sources = words.select("keyword", F.explode("_names").alias("s")).groupBy("keyword").agg(
        F.countDistinct("s").alias("sources"))
    return (issues.join(sources, "keyword").filter((F.col("issues") >= min_issues) & (F.col("sources") >= min_sources))
            .orderBy(F.desc("issues"), F.desc("sources"), F.asc("keyword")).limit(n))


def feed_metrics(briefs: DataFrame, as_of: Column, category: str = ALL) -> DataFrame:
    """Issues, today's issues and their mean impact. One row."""
    rows = briefs if category == ALL else briefs.filter(F.col("category") == category)
    today = in_date_preset("today", as_of)
    return rows.agg(F.count("*").alias("topics"), F.count_if(today).alias("today"),
                    F.coalesce(F.avg(F.when(today, F.col("impact"))), F.lit(0.0)).alias("mean_impact"))


def weekly_stats(briefs: DataFrame, stored: DataFrame) -> DataFrame:
    """Per category: issues, articles, sources, mean impact, top issue. Counts and title of a stored weekly summary,
    (category, issue_count, article_count, title), go first where they are there."""
    order = F.struct((-F.col("impact")).alias("i"), (-F.unix_micros("latest_published_at")).alias("t"), "group_id")
    live = briefs.groupBy("category").agg(
        F.count("*").cast("int").alias("live_issues"), F.sum("article_count").cast("int").alias("live_articles"),
        F.avg("impact").alias("mean_impact"), F.min_by("title", order).alias("live_title"))
    sources = briefs.select("category", F.explode(F.filter(F.split("source", ", "), lambda s: s != "")).alias("s")).groupBy(
        "category").agg(F.countDistinct("s").cast("int").alias("source_count"))
    def stored_first(c, live_c):
        return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(live_c)).alias(c)
    return live.join(sources, "category", "left").join(stored, "category", "left").select(
        "category", stored_first("issue_count", "live_issues"), stored_first("article_count", "live_articles"),
        F.coalesce("source_count", F.lit(0)).alias("source_count"), "mean_impact",
        F.coalesce("title", "live_title").alias("top_title"))
