"""Candidates of a day, and issues that tell the same story twice."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from issueloom.functions.dates import korea_date
from issueloom.functions.signals import impact, is_low_value, selection_score
from issueloom.functions.text import clean_text, compact, contains_any, is_blank, tokens
from issueloom.operators.dedupe import effective_counts
from issueloom.operators.keywords import (
    keyword_distribution, keyword_score, rollup_keywords_of, top_keywords)
from issueloom.operators.overlap import meet, overlap_keys
from issueloom.operators.selection import greedy_select, rank_rows
from issueloom.rules import TOPIC_RULES
from issueloom.session import materialize

LONG_KEYWORD = 4
SHARED_ANY, SHARED_LONG = 4, 2


def in_range(groups: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Groups with `period`, the Korea day of their latest article, inside the days given."""
    out = groups.withColumn("period", korea_date(F.col("latest_published_at")))
    if start is not None:
        out = out.filter(F.col("period") >= start)
    if end is not None:
        out = out.filter(F.col("period") <= end)
    return out


def effective_scores(groups: DataFrame, effective: DataFrame) -> DataFrame:
    """Groups with counts after duplicate removal and the score that follows from them."""
    counted = effective_counts(groups, effective)
    low_title = is_low_value(clean_text(F.col("representative_title")), F.col("source_names"))
    return counted.withColumn("effective_score", impact(F.col("effective_articles"), F.col("effective_sources"), low_title))


def candidates(groups: DataFrame, effective: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per group of a period with everything an issue is picked by.

    `candidate_order` sorts the candidates of a period best first; comparing it takes the place of a row number,
    which would need each period in one task.
    """
    scored = effective_scores(groups, effective)
    both_titles = F.concat_ws(" ", "representative_title", "seed_title")
    base = scored.join(top_keywords(weights, 8), "group_id", "left").select(
        "period", "group_id", "category", "representative_title", "summary", "latest_published_at",
        F.col("effective_articles").alias("articles"), "source_names", "effective_score",
        is_low_value(both_titles, F.col("sources")).alias("low"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.struct((-F.col("effective_score")).alias("score"), (-F.col("article_count")).alias("stored"),
                 (-F.unix_micros("latest_published_at")).alias("latest"), "group_id").alias("candidate_order"))
    scores = keyword_score(base, keyword_distribution(weights, None if "labels" in weights.columns else base))
    return base.join(scores, ["period", "group_id"], "left").withColumn(
        "keyword_score", F.coalesce("keyword_score", F.lit(0))).withColumn(
        "selection_score", selection_score(F.col("effective_score"), F.col("keyword_score"), F.size("source_names"),
                                           F.col("articles")))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates numbered from 0 in every period, best first."""
    ranked = rank_rows(candidates.withColumn("_order", F.col("candidate_order")), "period", [F.asc("_order")])
    return ranked.withColumn("index", (F.col("rank") - 1).cast("int")).drop("rank", "_order")


FIRST_ISSUES = 512


def topic_match(text: Column, subjects: list[str], events: list[str]) -> Column:
    """Any subject word together with any event word."""
    cleaned = F.lower(clean_text(text))
    return contains_any(cleaned, subjects) & contains_any(cleaned, events)


def issue_keywords(issues: DataFrame, topics=TOPIC_RULES) -> DataFrame:
    """(window, id, rank, tokens, topics) of issues: the rollup keywords of their whole text, and their topics."""
    text = F.concat_ws(" ", "title", "summary", F.array_join("keywords", " "))
    found = rollup_keywords_of(tokens(clean_text(text)))
    hits = F.filter(F.array(*[F.when(topic_match(text, s, e), F.lit(name)) for name, s, e in topics]),
                    lambda t: t.isNotNull())
    return issues.select(F.col("period").alias("window"), F.col("issue_id").alias("id"), "rank", found.alias("tokens"),
                         hits.alias("topics"))


def rarest_first(nodes: DataFrame) -> DataFrame:
    """`tokens` reordered from rare to common inside each window, and the long ones by themselves."""
    words = nodes.select("window", "id", F.explode("tokens").alias("token"))
    counts = words.groupBy("window", "token").agg(F.count("*").alias("n"))
    lists = words.join(counts, ["window", "token"]).groupBy("window", "id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda s: s["token"]).alias("ordered"))
    none = F.array().cast("array<string>")
    return (nodes.drop("tokens").join(lists, ["window", "id"], "left")
            .withColumn("tokens", F.coalesce("ordered", none)).drop("ordered")
            .withColumn("long_tokens", F.filter("tokens", lambda t: F.length(t) >= LONG_KEYWORD)))


LEGS = [("any", "tokens", SHARED_ANY), ("long", "long_tokens", SHARED_LONG), ("topic", "topics", 1)]


def story_nodes(issues: DataFrame) -> DataFrame:
    """Ranked issues as nodes for `similar_issues`: ordered keywords, topics and the keys that they are joined by."""
    nodes = materialize(rarest_first(issue_keywords(issues)), "issue-keywords")
    return materialize(overlap_keys(nodes, LEGS), "issue-nodes")


def similar_issues(probe: DataFrame, index: DataFrame, one: bool | None = None) -> DataFrame:
    """(window, later, later_rank, earlier) of `story_nodes` that share four keywords, or two long ones, or a topic.

    With `one`, which holds where the two sides are different tables unless it is given, every issue that is similar to an
    earlier one comes with some of these, but perhaps not with all.
    """
    one = probe is not index if one is None else one
    met = meet(probe, index, one)
    sets = ["tokens", "long_tokens", "topics"]
    full = (met.join(probe.select("window", F.col("id").alias("later"), *[F.col(c).alias(f"p_{c}") for c in sets]), ["window", "later"])
            .join(index.select("window", F.col("id").alias("earlier"), *[F.col(c).alias(f"i_{c}") for c in sets]), ["window", "earlier"]))
    enough = (
        (F.size(F.array_intersect("p_tokens", "i_tokens")) >= SHARED_ANY)
        | (F.size(F.array_intersect("p_long_tokens", "i_long_tokens")) >= SHARED_LONG)
        | F.arrays_overlap("p_topics", "i_topics"))
    return full.filter(enough).select("window", "later", "later_rank", "earlier")


def rank_issues(issues: DataFrame) -> DataFrame:
    """Issues of a period in the order they claim their story."""
    order = F.struct(
        F.col("low").cast("int").alias("low"), F.when(F.col("parts") > 1, 0).otherwise(1).alias("single"),
        (-F.col("parts")).alias("parts"), (-F.col("selection_score")).alias("selection"), (-F.size("sources")).alias("sources"),
        (-F.col("articles")).alias("articles"), (-F.unix_micros("latest_published_at")).alias("latest"), "issue_id")
    return rank_rows(issues.withColumn("_order", order), "period", [F.asc("_order")]).drop("_order")


def dedupe_issues(issues: DataFrame, first_batch: int = FIRST_ISSUES) -> DataFrame:
    """Issues that no better kept issue of their period is similar to.

    Issues of one topic, or that share common words, are all similar to each other. Of each such group at most one is kept,
    and from the second batch on issues first meet the kept ones only; so all pairs of a group arise in its first
    `first_batch` issues at most. Of the kept ones that an issue meets, one is enough.
    """
    ranked = materialize(rank_issues(issues), "ranked")
    kept = greedy_select(story_nodes(ranked), lambda probe, index: similar_issues(probe, index), first_batch)
    return ranked.join(kept.select(F.col("window").alias("period"), F.col("id").alias("issue_id")),
                       ["period", "issue_id"], "left_semi").drop("rank")


def best_first(low: str = "low") -> list[Column]:
    return [F.col(low).cast("int").asc(), F.desc("selection_score"), F.size("sources").desc(), F.desc("articles")]


def top_categories(candidates: DataFrame, articles_of: DataFrame, n: int = 5) -> DataFrame:
    """(period, category, issue_count, article_count, place): the `n` largest categories of every period."""
    counts = category_counts(candidates, articles_of)
    order = Window.partitionBy("period").orderBy(F.desc("issue_count"), F.asc("category"))
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def category_counts(candidates: DataFrame, articles_of: DataFrame) -> DataFrame:
    """Issues and distinct articles per period and category. `articles_of` holds (group_id, article_id)."""
    issues = candidates.groupBy("period", "category").agg(F.count("*").cast("int").alias("issue_count"))
    articles = (candidates.select("period", "category", "group_id").join(articles_of, "group_id")
                .groupBy("period", "category").agg(F.countDistinct(F.lower("article_id")).cast("int").alias("article_count")))
    return issues.join(articles, ["period", "category"], "left").withColumn(
        "article_count", F.coalesce("article_count", F.lit(0)))


def period_totals(candidates: DataFrame, articles_of: DataFrame) -> DataFrame:
    """Groups, distinct articles and distinct sources per period."""
    issues = candidates.groupBy("period").agg(F.count("*").cast("int").alias("issue_count"))
    articles = (candidates.select("period", "group_id").join(articles_of, "group_id").groupBy("period")
                .agg(F.countDistinct(F.lower("article_id")).cast("int").alias("article_count")))
    sources = (candidates.select("period", F.explode("source_names").alias("source")).groupBy("period")
               .agg(F.countDistinct(F.lower("source")).cast("int").alias("source_count")))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("article_count", "source_count")]
    return issues.join(articles, "period", "left").join(sources, "period", "left").select("period", "issue_count", *zero)


def top_issues(issues: DataFrame, categories: DataFrame, per_category: int = 4, most: int = 20) -> DataFrame:
    """The best issues of every category, then the best `most` of every period, numbered in `place`."""
    by_category = Window.partitionBy("period", "category").orderBy(
        *best_first(), F.desc("latest_published_at"), F.asc("issue_id"))
    short = issues.withColumn("_k", F.row_number().over(by_category)).filter(F.col("_k") <= per_category).drop("_k")
    weighed = short.join(categories.select("period", "category", F.col("issue_count").alias("category_issues")),
                         ["period", "category"], "left").withColumn(
        "category_issues", F.coalesce("category_issues", F.lit(0)))
    overall = Window.partitionBy("period").orderBy(
        F.desc("category_issues"), *best_first(), F.desc("latest_published_at"), F.asc("issue_id"))
    return (weighed.withColumn("place", F.row_number().over(overall)).filter(F.col("place") <= most)
            .drop("category_issues"))


def evidence(issue_articles: DataFrame, articles: DataFrame, n: int = 2) -> DataFrame:
    """(period, issue_id, pos, title, source, summary, excerpt, url): articles with a body first, then the newest."""
    narrow = articles.select(F.col("id").alias("article_id"), is_blank(F.col("content")).alias("bare"), "published_at")
    order = Window.partitionBy("period", "issue_id").orderBy("bare", F.desc("published_at"), "article_id")
    picked = (issue_articles.dropDuplicates(["period", "issue_id", "article_id"]).join(narrow, "article_id")
              .withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n))
    return picked.join(articles.select(F.col("id").alias("article_id"), "title", "source", "summary", "content", "url"),
                       "article_id").select(
        "period", "issue_id", "pos", clean_text(F.col("title")).alias("title"), clean_text(F.col("source")).alias("source"),
        compact(F.col("summary"), 350).alias("summary"), compact(F.col("content"), 1000).alias("excerpt"), "url")


def category_lead(categories: DataFrame, issues: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each category row with the title and keywords of its best issue, else of its best candidate."""
    def lead(df, title, keywords, size):
        order = F.struct(F.col("low").cast("int").alias("low"), (-F.col("selection_score")).alias("sel"),
                         (-F.size(size)).alias("ns"), (-F.col("articles")).alias("na"),
                         (-F.unix_micros("latest_published_at")).alias("latest"), F.col(df.columns[1]).alias("id"))
        return df.groupBy("period", "category").agg(F.min_by(F.struct(title, keywords), order).alias("lead"))

    best = lead(issues.select("period", "issue_id", "category", "title", "keywords", "low", "selection_score", "sources",
                              "articles", "latest_published_at"), F.col("title"), F.col("keywords"), "sources")
    fallback = lead(candidates.select("period", "group_id", "category", "representative_title", "keywords", "low",
                                      "selection_score", "source_names", "articles", "latest_published_at"),
                    clean_text(F.col("representative_title")).alias("title"), F.col("keywords"), "source_names")
    return (categories.join(best, ["period", "category"], "left")
            .join(fallback.withColumnRenamed("lead", "other"), ["period", "category"], "left")
            .withColumn("lead_title", F.coalesce("lead.title", "other.title"))
            .withColumn("lead_keywords", F.coalesce("lead.keywords", "other.keywords")).drop("lead", "other"))
