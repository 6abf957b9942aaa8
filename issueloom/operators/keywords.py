"""Keyword statistics of issue groups."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from issueloom.functions.text import clean_text, compact, tokens
from issueloom.rules import COUNTED_UNIT_PATTERN, REPORTER_SUFFIX, ROLLUP_STOPWORDS, STOPWORDS

NEWEST = 8  # articles of a group that lend it keywords
BODY_CHARS = 2500


def _in_list(name: str, words: list[str]) -> str:
    return f"{name} in (" + ", ".join(f"'{w}'" for w in words) + ")"


# As SQL text a word list is one call to the JVM and becomes a hash set there.
def keyword_sql(name: str) -> str:
    return (
        f"(length({name}) between 2 and 30 and not {name} rlike '^[0-9]+$' and not {_in_list(name, STOPWORDS)} "
        f"and not (endswith({name}, '{REPORTER_SUFFIX}') and length({name}) <= 5))"
    )


def rollup_keyword_sql(name: str) -> str:
    return (
        f"({keyword_sql(name)} and not {name} rlike r'{COUNTED_UNIT_PATTERN}' "
        f"and not ({name} rlike '[0-9]' and length({name}) <= 4) "
        f"and not (length({name}) <= 3 and {name} rlike r'^[\x00-\x7F]+$') and not {_in_list(name, ROLLUP_STOPWORDS)})"
    )


def is_keyword(name: str) -> Column:
    return F.expr(keyword_sql(name))


def is_rollup_keyword(name: str) -> Column:
    """Keywords telling enough to merge issues by."""
    return F.expr(rollup_keyword_sql(name))


def rollup_keywords_of(words: Column) -> Column:
    """The rollup keywords of an array, each once."""
    return F.call_function("filter", F.array_distinct(words), F.expr(f"k -> {rollup_keyword_sql('k')}"))


def newest_members(effective: DataFrame, n: int | None = None) -> DataFrame:
    """The articles of every group numbered newest first; with `n` the first ones, cut before the shuffle too."""
    order = Window.partitionBy("group_id").orderBy("order_key")
    placed = effective.withColumn("pos", F.row_number().over(order))
    return placed if n is None else placed.filter(F.col("pos") <= n)


def keyword_weights(groups: DataFrame, effective: DataFrame, articles: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """(group_id, keyword, weight): every occurrence adds the weight of the text it stands in.

    `labels` names columns of `groups` to be kept beside the words as an array of structs `labels`, which spares a join with all
    words later. The few texts of a group are brought together before they are cut into words: texts are shuffled, not words,
    and a group's words come to lie in one file.
    """
    def part(text: Column, weight: int) -> Column:
        return F.struct(text.alias("text"), F.lit(weight).alias("w"))

    own = groups.select("group_id", F.array(
        part(clean_text(F.col("representative_title")), 4), part(clean_text(F.col("seed_title")), 3),
        part(clean_text(F.col("summary")), 2)).alias("parts"))
    # bodies are cut before they are joined, so the shuffle carries what is counted and no more
    texts = articles.filter(~F.col("is_excluded")).select(F.col("id").alias("article_id"), F.array(
        part(clean_text(F.col("title")), 3), part(clean_text(F.col("summary")), 2),
        part(compact(F.col("content"), BODY_CHARS), 1)).alias("parts"))
    lent = newest_members(effective, NEWEST).select("group_id", "article_id").join(texts, "article_id").select(
        "group_id", "parts")
    texts_of = own.unionByName(lent).repartition("group_id")
    key = ["group_id"]
    if labels:
        texts_of = texts_of.join(groups.groupBy("group_id").agg(F.collect_list(F.struct(*labels)).alias("labels")), "group_id", "left")
        key.append("labels")
    words = (texts_of.select(*key, F.explode("parts").alias("p"))
             .select(*key, F.col("p.w").alias("w"), F.explode(tokens(F.col("p.text"))).alias("keyword")))
    return words.filter(is_keyword("keyword")).groupBy(*key, "keyword").agg(F.sum("w").cast("int").alias("weight"))


def top_keywords(weights: DataFrame, k: int, key: list[str] | None = None) -> DataFrame:
    """(key.., keywords): the `k` heaviest keywords in order, by name on a tie."""
    key = key or ["group_id"]
    order = Window.partitionBy(*key).orderBy(F.desc("weight"), F.asc("keyword"))
    ranked = weights.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
    return ranked.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda s: s["keyword"]).alias("keywords"))


def keyword_distribution(weights: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(period, category, keyword, total) over groups labelled with period and category; without `labelled` the weights
    carry these labels."""
    if labelled is None:
        rows = weights.select("keyword", "weight", F.explode("labels").alias("l")).select("l.period", "l.category", "keyword", "weight")
    else:
        rows = weights.join(labelled.select("group_id", "period", "category"), "group_id")
    return rows.groupBy("period", "category", "keyword").agg(F.sum("weight").cast("int").alias("total"))


def keyword_score(candidates: DataFrame, distribution: DataFrame) -> DataFrame:
    """(period, group_id, keyword_score): how common the group's first six keywords are in its category."""
    asked = candidates.select("period", "category", "group_id", F.explode(F.slice("keywords", 1, 6)).alias("keyword"))
    return (asked.join(distribution, ["period", "category", "keyword"]).groupBy("period", "group_id")
            .agg(F.sum("total").cast("int").alias("keyword_score")))
