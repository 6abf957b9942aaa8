"""Merging the issues of a day that keep naming the same keyword pair."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from issueloom.functions.narrative import merged_summary, merged_title
from issueloom.functions.signals import (
    is_low_value, merged_score, merged_selection, rollup_members_ok, rollup_priority, rollup_size_ok)
from issueloom.functions.text import clean_text
from issueloom.operators.keywords import is_rollup_keyword, newest_members, top_keywords
from issueloom.session import materialize

TOP_ROLLUP, PAIRED = 12, 8
MIN_POSTINGS = 3
FINISH_ROWS = 200_000  # component rows of one period that one task may finish


def posting_limit(total: Column) -> Column:
    return F.least(F.lit(300), F.greatest(F.lit(30), F.floor(total / 8)))


def keyword_pairs(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """(period, group_id, k1, k2): pairs, in order, of the first eight of a group's top rollup keywords."""
    tops = top_keywords(weights.filter(is_rollup_keyword("keyword")), TOP_ROLLUP)
    lists = candidates.select("period", "group_id").join(tops, "group_id").select(
        "period", "group_id", F.array_sort(F.slice("keywords", 1, PAIRED)).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda a, i: F.transform(
        F.slice(F.col("ks"), i + 2, PAIRED), lambda b: F.struct(a.alias("k1"), b.alias("k2")))))
    return lists.select("period", "group_id", F.explode(pairs).alias("p")).select(
        "period", "group_id", "p.k1", "p.k2")


def pair_components(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """(period, component, group_id, k1, k2): groups that share a pair, one component per distinct member set.

    Pairs with too few or too many postings go before anything is collected, so a list never exceeds 300.
    """
    counts = pairs.groupBy("period", "k1", "k2").count().join(totals.select("period", "total"), "period")
    bounded = counts.filter((F.col("count") >= MIN_POSTINGS) & (F.col("count") <= posting_limit(F.col("total"))))
    lists = (pairs.join(bounded.select("period", "k1", "k2"), ["period", "k1", "k2"], "left_semi")
             .groupBy("period", "k1", "k2").agg(F.array_sort(F.collect_set("group_id")).alias("members")))
    distinct = lists.groupBy("period", F.sha2(F.array_join("members", ","), 256).alias("component")).agg(
        F.min(F.struct("k1", "k2")).alias("pair"), F.any_value("members").alias("members"))
    return distinct.select("period", "component", F.explode("members").alias("group_id"), "pair.k1", "pair.k2")


def _few(array: str, n: int) -> Column:
    return F.slice(F.array_distinct(F.flatten(F.collect_list(array))), 1, n)


def member_facts(candidates: DataFrame, effective: DataFrame) -> DataFrame:
    """Candidates with bounded samples of article and source hashes.

    Counts below are only compared with small bounds, and a group with that many articles settles it alone,
    so 100 articles and 10 sources per group give exact answers.
    """
    ids = newest_members(effective, 100).groupBy("group_id").agg(
        F.collect_list(F.xxhash64(F.lower("article_id"))).alias("article_sample"))
    names = F.slice(F.array_distinct(F.transform("source_names", lambda s: F.xxhash64(F.lower(s)))), 1, 10)
    empty = F.array().cast("array<bigint>")
    return candidates.join(ids, "group_id", "left").select(
        "period", "group_id", "low", "selection_score", "candidate_order",
        F.coalesce("article_sample", empty).alias("article_sample"), F.coalesce(names, empty).alias("source_sample"))


def prioritise(components: DataFrame, facts: DataFrame, totals: DataFrame) -> DataFrame:
    """Component rows with the component's priority, fixed on its full member set."""
    rows = components.join(facts, ["period", "group_id"])
    score = rows.groupBy("period", "component").agg(
        F.count("*").cast("int").alias("n"), F.size(_few("article_sample", 100)).alias("a"),
        F.size(_few("source_sample", 10)).alias("s"), F.max("selection_score").alias("best"),
        F.min("candidate_order").alias("first"))
    ranked = score.select("period", "component", rollup_priority(F.col("n"), F.col("a"), F.col("s"), F.col("best"))
                          .alias("priority"), "first")
    return rows.join(ranked, ["period", "component"]).join(totals.select("period", "total"), "period").select(
        "period", "component", "group_id", "low", "total", "priority",
        F.slice("article_sample", 1, 5).alias("articles5"), F.slice("source_sample", 1, 3).alias("sources3"),
        F.struct((-F.col("priority")).alias("p"), "first", "k1", "k2", "component").alias("turn"))


def _greedy_period(rows: pd.DataFrame) -> pd.DataFrame:
    """The plain scan of one period: components take their free members in turn."""
    taken, out = set(), []
    total = int(rows["total"].iloc[0])
    for _, part in rows.sort_values(["place", "group_id"]).groupby("place", sort=True):
        free = part[~part["group_id"].isin(taken)]
        n = len(free)
        if n < 3 or n > max(250, total // 8) or free["low"].all():
            continue
        articles = {x for xs in free["articles5"] for x in xs}
        sources = {x for xs in free["sources3"] for x in xs}
        if n >= 5 or len(articles) >= 5 or len(sources) >= 3:
            taken.update(free["group_id"])
            out.append(free[["period", "component", "group_id"]])
    return pd.concat(out) if out else rows.iloc[:0][["period", "component", "group_id"]]


def select_rollups(rows: DataFrame, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(period, component, group_id) of the merged issues.

    In turn, a component takes the members no earlier one took, and stands if what it took is enough. All periods
    run at once: components that cannot stand any more are dropped, and those that are first in turn for all their
    remaining members are settled, round by round; a period whose rest fits a task is finished by a plain scan.
    """
    rows = materialize(rows, "components")
    accepted = []
    while True:
        largest = rows.groupBy("period").count().agg(F.max("count")).first()[0]
        if largest is None:
            break
        if largest <= finish_rows:
            place = rows.select("period", "component", "turn").distinct().withColumn(
                "place", F.row_number().over(Window.partitionBy("period").orderBy("turn")))
            slim = rows.join(place.drop("turn"), ["period", "component"]).select(
                "period", "component", "group_id", "low", "total", "place", "articles5", "sources3")
            accepted.append(slim.groupBy("period").applyInPandas(
                _greedy_period, "period date, component string, group_id string"))
            break
        state = rows.groupBy("period", "component").agg(
            F.count("*").alias("n"), F.bool_and("low").alias("all_low"), F.size(_few("articles5", 5)).alias("a"),
            F.size(_few("sources3", 3)).alias("s"), F.first("total").alias("total"))
        viable = state.filter(rollup_members_ok(F.col("n"), F.col("a"), F.col("s"), F.col("all_low")))
        rows = materialize(rows.join(viable.select(
            "period", "component", rollup_size_ok(F.col("n"), F.col("total")).alias("size_ok")), ["period", "component"]), "viable")
        first = rows.groupBy("period", "group_id").agg(F.min("turn").alias("first_turn"))
        settled = (rows.join(first, ["period", "group_id"]).groupBy("period", "component")
                   .agg(F.bool_and(F.col("turn") == F.col("first_turn")).alias("settled")).filter("settled"))
        mine = rows.join(settled.select("period", "component"), ["period", "component"], "left_semi")
        won = materialize(mine.filter("size_ok").select("period", "component", "group_id"), "won")
        accepted.append(won)
        rows = materialize(
            rows.join(settled.select("period", "component"), ["period", "component"], "left_anti")
            .join(won.select("period", "group_id"), ["period", "group_id"], "left_anti").drop("size_ok"), "rest")
    if not accepted:
        return rows.select("period", "component", "group_id")
    out = accepted[0]
    for part in accepted[1:]:
        out = out.unionByName(part)
    return out


ISSUE_COLUMNS = ["period", "issue_id", "title", "category", "summary", "articles", "sources", "source_count", "score",
                 "selection_score", "keywords", "latest_published_at", "low", "parts"]


def single_issues(candidates: DataFrame, merged: DataFrame) -> DataFrame:
    """Candidates that joined no merged issue, in the shape of issues."""
    alone = candidates.join(merged.select("period", "group_id"), ["period", "group_id"], "left_anti")
    return alone.select(
        "period", F.col("group_id").alias("issue_id"), clean_text(F.col("representative_title")).alias("title"),
        "category", clean_text(F.col("summary")).alias("summary"), "articles", F.slice("source_names", 1, 4).alias("sources"),
        F.size("source_names").alias("source_count"), F.col("effective_score").alias("score"), "selection_score",
        "keywords", "latest_published_at", "low", F.lit(1).alias("parts"))


def merged_issues(candidates: DataFrame, merged: DataFrame, effective: DataFrame, weights: DataFrame) -> DataFrame:
    """One issue per component: lead text, category by weight, distinct counts, summed keywords, raised scores."""
    key = ["period", "issue_id"]
    rows = merged.withColumnRenamed("component", "issue_id").join(candidates, ["period", "group_id"])
    lead_order = F.struct(
        F.col("low").cast("int").alias("low"), (-F.col("selection_score")).alias("sel"),
        (-F.size("source_names")).alias("ns"), (-F.col("articles")).alias("na"),
        (-F.unix_micros("latest_published_at")).alias("latest"), "group_id")
    base = rows.groupBy(*key).agg(
        F.min_by(F.struct("representative_title", "selection_score"), lead_order).alias("lead"),
        F.count("*").cast("int").alias("parts"), F.max("latest_published_at").alias("latest_published_at"),
        F.bool_and("low").alias("low"), F.sum("articles").cast("int").alias("summed"))
    weight = rows.groupBy(*key, "category").agg(F.sum("selection_score").alias("w"), F.count("*").alias("n"))
    category = weight.groupBy(*key).agg(
        F.min(F.struct((-F.col("w")).alias("w"), (-F.col("n")).alias("n"), "category"))["category"].alias("category"))
    sources = (rows.select(*key, "candidate_order", F.posexplode("source_names").alias("pos", "source"))
               .groupBy(*key, F.lower("source").alias("source_key"))
               .agg(F.min(F.struct("candidate_order", "pos", "source")).alias("f")).groupBy(*key)
               .agg(F.transform(F.array_sort(F.collect_list("f")), lambda s: s["source"]).alias("all_sources")))
    articles = (rows.select(*key, "group_id").join(effective.select("group_id", "article_id"), "group_id")
                .groupBy(*key).agg(F.countDistinct(F.lower("article_id")).cast("int").alias("distinct_articles")))
    telling = weights.filter(is_rollup_keyword("keyword")).select("group_id", "keyword", "weight")
    summed = (rows.select(*key, "group_id").join(telling, "group_id")
              .groupBy(*key, "keyword").agg(F.sum("weight").cast("int").alias("weight")))
    keywords = top_keywords(summed, 8, key)
    none = F.array().cast("array<string>")
    wide = (base.join(category, key).join(sources, key, "left").join(articles, key, "left").join(keywords, key, "left")
            .withColumns({"all_sources": F.coalesce("all_sources", none), "keywords": F.coalesce("keywords", none),
                          "articles": F.coalesce("distinct_articles", "summed")})
            .withColumn("title", merged_title(F.col("lead.representative_title"), F.col("keywords")))
            .withColumn("source_count", F.size("all_sources")))
    low = is_low_value(F.col("lead.representative_title"), F.col("all_sources"))
    return wide.select(
        *key, "title", "category", merged_summary(F.col("title"), F.col("parts"), F.col("keywords")).alias("summary"),
        "articles", F.slice("all_sources", 1, 4).alias("sources"), "source_count",
        merged_score(F.col("articles"), F.col("source_count"), low, F.col("parts")).alias("score"),
        merged_selection(F.col("lead.selection_score"), F.col("parts"), F.col("articles"), F.col("source_count"))
        .alias("selection_score"),
        "keywords", "latest_published_at", "low", "parts")


def issue_groups(candidates: DataFrame, merged: DataFrame) -> DataFrame:
    """(period, issue_id, group_id): the groups every issue, merged or single, is made of."""
    alone = candidates.select("period", "group_id").join(
        merged.select("period", "group_id"), ["period", "group_id"], "left_anti")
    return merged.select("period", F.col("component").alias("issue_id"), "group_id").unionByName(
        alone.select("period", F.col("group_id").alias("issue_id"), "group_id"))
