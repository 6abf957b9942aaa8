"""Following summary issues back to the briefs they came from.

`issues` hold (issue_key, title, category, ..), `issue_articles` (issue_key, article_id), `briefs` the feed rows and
`brief_articles` (group_id, article_id). A place in the feed decides between briefs: `pos`, smallest first.
"""

from pyspark.sql import Column, DataFrame, functions as F

from issueloom.functions.text import is_blank, normalize_title
from issueloom.functions.urls import safe_url
from issueloom.operators.search import source_names


def with_positions(briefs: DataFrame) -> DataFrame:
    return briefs.withColumn("pos", F.struct((-F.unix_micros("latest_published_at")).alias("t"), F.col("group_id").alias("g")))


def track_by_ids(issue_articles: DataFrame, brief_articles: DataFrame) -> DataFrame:
    """(issue_key, group_id) of every brief that shares an article with the issue."""
    a = issue_articles.filter(~is_blank(F.col("article_id"))).select("issue_key", "article_id").distinct()
    b = brief_articles.select("group_id", "article_id").distinct()
    return a.join(b, "article_id").select("issue_key", "group_id").distinct()


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of `size` characters."""
    count = F.length(text) - size + 1
    return F.array_distinct(F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
                                        lambda i: F.substr(text, i, F.lit(size))))


def contained_pairs(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short_id, long_id) where the text `s` of `short` occurs in the text `s` of `long`; blank texts occur nowhere.

    A text that occurs in another brings all its runs of characters along, so it is enough to join on one: the run that the
    fewest other texts hold. Runs are as long as the text allows, up to eight characters.
    """
    sizes = (8, 4, 2, 1)
    size = F.lit(1)
    for n in reversed(sizes):
        size = F.when(F.length("s") >= n, F.lit(n)).otherwise(size)
    inner = short.filter("s <> ''").withColumn("size", size)
    own = inner.select("id", "size", F.explode(
        F.when(F.col("size") == 8, _grams(F.col("s"), 8)).when(F.col("size") == 4, _grams(F.col("s"), 4))
        .when(F.col("size") == 2, _grams(F.col("s"), 2)).otherwise(_grams(F.col("s"), 1))).alias("gram"))
    # what is exploded is estimated at the size it had before, and would be sent to the driver whole: both sides are shuffled
    held = long.select(F.col("id").alias("long_id"), F.explode(F.concat(*[_grams(F.col("s"), n) for n in sizes])).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.hint("merge").join(counts.hint("merge"), "gram").groupBy("id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    met = rarest.hint("merge").join(held.hint("merge"), "gram").select("id", "long_id")
    texts = long.select(F.col("id").alias("long_id"), F.col("s").alias("ls"))
    return (met.join(inner.select("id", "s"), "id").join(texts, "long_id").filter(F.col("ls").contains(F.col("s")))
            .select(F.col("id").alias("short_id"), "long_id"))


def track_by_title(issues: DataFrame, briefs: DataFrame) -> DataFrame:
    """(issue_key, group_id): the first brief by title. Same title in the same category goes before the same title
    anywhere, and that before one title inside the other in the same category.

    Equal titles are an equi-join. For issues still unmatched, titles inside one another are joined on a rare part.
    """
    i = issues.select("issue_key", "category", normalize_title(F.col("title")).alias("t"))
    b = with_positions(briefs).select("group_id", F.col("category").alias("bc"), normalize_title(F.col("title")).alias("bt"), "pos")
    anywhere = F.col("category").isNull() | (F.col("category") == "")
    same = anywhere | (F.col("category") == F.col("bc"))
    equal = i.join(b, F.col("t") == F.col("bt")).select(
        "issue_key", "group_id", "pos", F.when(same, 1).otherwise(2).alias("rule"))
    left = i.join(equal.select("issue_key").distinct(), "issue_key", "left_anti").filter("t <> ''")
    ours, theirs = left.select(F.col("issue_key").alias("id"), F.col("t").alias("s")), b.select(F.col("group_id").alias("id"), F.col("bt").alias("s"))
    # every title holds a blank one; such briefs are few and come first of all of their category
    blank = b.filter("bt = ''").groupBy("bc").agg(F.min_by(F.struct("group_id", "pos"), "pos").alias("e"))
    near = contained_pairs(ours, theirs).select(F.col("short_id").alias("issue_key"), F.col("long_id").alias("group_id")).unionByName(
        contained_pairs(theirs, ours).select(F.col("long_id").alias("issue_key"), F.col("short_id").alias("group_id"))).distinct()
    inside = near.join(left, "issue_key").join(b, "group_id").filter(same).select("issue_key", "group_id", "pos")
    empty = left.join(blank, (left["category"] == blank["bc"]) | left["category"].isNull() | (left["category"] == "")).select(
        "issue_key", "e.group_id", "e.pos")
    inside = inside.unionByName(empty).withColumn("rule", F.lit(3))
    return equal.unionByName(inside).groupBy("issue_key").agg(
        F.min_by("group_id", F.struct("rule", "pos")).alias("group_id"))


def merge_tracked(issues: DataFrame, issue_articles: DataFrame, matches: DataFrame, briefs: DataFrame,
                  brief_articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracked issues, their article ids): all briefs of an issue as one, links once per URL, first kept."""
    rows = matches.join(with_positions(briefs).withColumn("names", source_names()), "group_id")
    lead = rows.groupBy("issue_key").agg(F.min_by(F.struct("title", "category", "summary", "source", "article_count"), "pos").alias("lead"))

    def in_order(values, field):
        firsts = (rows.select("issue_key", F.struct("pos").alias("o"), F.posexplode(values).alias("i", field))
                  .filter(~is_blank(F.col(field))).groupBy("issue_key", field).agg(F.min(F.struct("o", "i")).alias("at")))
        return firsts.groupBy("issue_key").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("at", field))), lambda s: s[field]).alias(f"{field}s"))

    links = (rows.select("issue_key", "pos", F.posexplode("related_links").alias("i", "link"))
             .withColumn("url", safe_url(F.col("link.url"))).filter("url <> ''")
             .groupBy("issue_key", "url").agg(F.min_by("link", F.struct("pos", "i")).alias("link"), F.min(F.struct("pos", "i")).alias("at"))
             .groupBy("issue_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "link"))), lambda s: s["link"])
                                       .alias("related_links")))
    ids = (matches.join(brief_articles.select("group_id", "article_id"), "group_id").select("issue_key", "article_id")
           .unionByName(issue_articles.select("issue_key", "article_id")).distinct())
    counts = ids.groupBy("issue_key").agg(F.count("*").cast("int").alias("known_articles"))
    none = F.array().cast("array<string>")
    tracked = (
        issues.join(lead, "issue_key").join(in_order("publishers", "publisher"), "issue_key", "left")
        .join(in_order("names", "name"), "issue_key", "left").join(links, "issue_key", "left").join(counts, "issue_key", "left")
        .select(
            "issue_key",
            F.when(~is_blank(F.col("title")), F.col("title")).otherwise(F.col("lead.title")).alias("title"),
            F.when(~is_blank(F.col("category")), F.col("category")).otherwise(F.col("lead.category")).alias("category"),
            F.when(~is_blank(F.col("summary")), F.col("summary")).otherwise(F.col("lead.summary")).alias("summary"),
            F.coalesce(F.nullif(F.array_join(F.slice("names", 1, 2), ", "), F.lit("")), F.col("lead.source")).alias("source"),
            F.coalesce("publishers", none).alias("publishers"),
            F.coalesce(F.nullif(F.col("article_count"), F.lit(0)), F.nullif("known_articles", F.lit(0)),
                       F.nullif("lead.article_count", F.lit(0)), F.size("related_links"), F.lit(0))
            .alias("article_count"),
            F.size("related_links").alias("link_count"), "related_links"))
    return tracked, ids


def tracked_issues(issues: DataFrame, issue_articles: DataFrame, briefs: DataFrame, brief_articles: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """(tracked issues, their article ids): all briefs that share an article as one, else the brief found by title as it is."""
    by_id = track_by_ids(issue_articles, brief_articles.join(briefs.select("group_id"), "group_id", "left_semi"))
    rest = issues.join(by_id.select("issue_key").distinct(), "issue_key", "left_anti")
    by_title = track_by_title(rest, briefs)
    merged, ids = merge_tracked(issues, issue_articles, by_id, briefs, brief_articles)
    lone = by_title.join(briefs, "group_id").select(
        "issue_key", "title", "category", "summary", "source", F.coalesce("publishers", F.array().cast("array<string>")).alias("publishers"),
        F.col("article_count").cast("int").alias("article_count"), F.size("related_links").alias("link_count"), "related_links")
    lone_ids = by_title.join(brief_articles.select("group_id", "article_id"), "group_id").select("issue_key", "article_id")
    return merged.unionByName(lone), ids.join(merged.select("issue_key"), "issue_key", "left_semi").unionByName(lone_ids)
