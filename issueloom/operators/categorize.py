"""Rule-based categories: the rule with the most distinct words found in an issue's text wins."""

from pyspark.sql import Column, DataFrame, functions as F

from issueloom.functions.text import or_empty
from issueloom.rules import CATEGORY_RULES, DEFAULT_CATEGORY, PHOTO_CATEGORY, PHOTO_SECTION

WORDS_PER_MASK = 62


def _masks(rules: list[tuple[str, list[str]]]) -> list[tuple[int, list[str]]]:
    """(rule number, words) slices small enough for the bits of one long."""
    return [(number, words[i:i + WORDS_PER_MASK])
            for number, (_, words) in enumerate(rules) for i in range(0, len(words), WORDS_PER_MASK)]


def word_masks(text: str, rules=CATEGORY_RULES) -> list[Column]:
    """One bit per rule word that occurs in the lower-case column `text`."""
    def bit(i: int, word: str) -> str:
        escaped = word.lower().replace("\\", "\\\\").replace("'", "\\'")
        return f"if(contains({text}, '{escaped}'), {1 << i}L, 0L)"
    return [F.expr(" + ".join(bit(i, w) for i, w in enumerate(words))) for _, words in _masks(rules)]


def best_category(masks: list[Column], photo: Column, rules=CATEGORY_RULES, default: str = DEFAULT_CATEGORY) -> Column:
    scores = {}
    for (number, _), mask in zip(_masks(rules), masks):
        scores[number] = scores.get(number, F.lit(0)) + F.bit_count(mask)
    ranked = F.array(*[F.struct(scores[n].alias("score"), F.lit(-n).alias("order"), F.lit(rules[n][0]).alias("category"))
                       for n in scores])
    top = F.array_max(ranked)
    return F.when(photo, F.lit(PHOTO_CATEGORY)).when(top["score"] > 0, top["category"]).otherwise(F.lit(default))


def article_category(articles: DataFrame, rules=CATEGORY_RULES, default: str = DEFAULT_CATEGORY) -> DataFrame:
    """`articles` with the category each would have as an issue of its own. A map-only plan."""
    head = F.lower(F.concat_ws(" ", "source", "title"))
    text = F.lower(F.concat_ws(" ", "source", "title", "summary", "content"))
    masks = word_masks("_text", rules)
    return (articles.withColumn("_text", text)
            .withColumn("category", best_category(masks, head.contains(PHOTO_SECTION), rules, default)).drop("_text"))


def categorize(members: DataFrame, articles: DataFrame, rules=CATEGORY_RULES, default: str = DEFAULT_CATEGORY
               ) -> DataFrame:
    """(group_id, category). Word hits become bit masks next to the text; only the masks are shuffled."""
    head = F.lower(F.concat_ws(" ", "source", "title"))
    text = F.lower(F.concat_ws(" ", *[or_empty(F.col(c)) for c in ("source", "title", "summary", "content")]))
    hits = articles.select(F.col("id").alias("article_id"), head.contains(PHOTO_SECTION).alias("photo"), text.alias("t"))
    masks = word_masks("t", rules)
    names = [f"m{i}" for i in range(len(masks))]
    hits = hits.select("article_id", "photo", *[m.alias(n) for m, n in zip(masks, names)])
    merged = members.join(hits, "article_id").groupBy("group_id").agg(
        F.bool_or("photo").alias("photo"), *[F.bit_or(n).alias(n) for n in names])
    return merged.select("group_id", best_category([F.col(n) for n in names], F.col("photo"), rules, default)
                         .alias("category"))
