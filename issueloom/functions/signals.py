"""Scores and flags an issue is ranked by."""

from pyspark.sql import Column, functions as F

from issueloom.functions.text import contains_any, or_empty
from issueloom.rules import LOW_VALUE_WORDS


def impact(articles: Column, sources: Column, low_value: Column | None = None) -> Column:
    """0 to 100 from counts after duplicate removal; few sources cap the score."""
    raw = F.least(F.lit(100), 30 + articles * 4 + sources * 3)
    cap = F.when(sources <= 1, 55).when(sources == 2, 68).when(sources == 3, 78).otherwise(100)
    score = F.when(articles <= 0, F.lit(0)).otherwise(F.least(raw, cap))
    if low_value is not None:
        score = F.when(low_value, F.least(score, F.lit(45))).otherwise(score)
    return score.cast("int")


def heat(score: Column) -> Column:
    return F.when(score >= 80, F.lit("hot")).otherwise(F.lit("normal"))


def is_low_value(title: Column, sources: Column) -> Column:
    """Photo sections: many articles there say nothing about weight."""
    text = F.lower(F.concat_ws(" ", sources, or_empty(title)))
    return contains_any(text, LOW_VALUE_WORDS)


def rollup_priority(parts: Column, articles: Column, sources: Column, best: Column) -> Column:
    return (
        F.least(F.lit(600), parts * 6) + F.least(F.lit(200), articles * 2)
        + F.least(F.lit(120), sources * 12) + F.least(F.lit(120), best)
    ).cast("int")


def rollup_size_ok(parts: Column, total: Column) -> Column:
    return parts <= F.greatest(F.lit(250), F.floor(total / 8))


def rollup_members_ok(parts: Column, articles: Column, sources: Column, all_low: Column) -> Column:
    return (parts >= 3) & ~all_low & ((parts >= 5) | (articles >= 5) | (sources >= 3))


def selection_score(score: Column, keyword_weight: Column, sources: Column, articles: Column) -> Column:
    """Issue score plus bounded bonuses for frequent keywords, sources and articles."""
    return (
        score + F.least(F.lit(40), F.rint(F.sqrt(keyword_weight.cast("double")) * 4).cast("int"))
        + F.least(F.lit(20), sources * 4) + F.least(F.lit(15), articles * 2)
    ).cast("int")


def merged_score(articles: Column, sources: Column, low_value: Column, parts: Column) -> Column:
    return F.least(F.lit(100), impact(articles, sources, low_value)
                   + F.least(F.lit(20), (parts - 1) * 3)).cast("int")


def merged_selection(best: Column, parts: Column, articles: Column, sources: Column) -> Column:
    return (best + F.least(F.lit(120), parts * 6) + F.least(F.lit(80), articles * 2)
            + F.least(F.lit(60), sources * 8)).cast("int")


def weekly_score(best: Column, days: Column) -> Column:
    return F.least(F.lit(100), best + F.least(F.lit(20), (days - 1) * 5)).cast("int")


def ratio(part: Column, total: Column) -> Column:
    """Share to two places, half-even."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.rint(part / total * 100) / 100)
