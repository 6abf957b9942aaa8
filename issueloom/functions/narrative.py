"""Sentences shown with issues and summaries."""

from pyspark.sql import Column, functions as F

from issueloom.functions.dates import day_key
from issueloom.functions.text import clean_text, count_phrase, is_blank, or_empty

# ---- fixed sentence parts ------------------------------------------------
RELATED_FALLBACK = " related articles were detected in this issue group."
SAFE_FALLBACK = ("개 관련 기사가 묶인 이슈입니다. 자세한 내용은 원문 링크에서 확인해 주세요. 확인 출처 ", "개.")
LEAD = " 이슈가 가장 두드러졌고, 이 카테고리에서 "
LEAD_COUNT = "개 이슈가 확인됐습니다."
LEAD_KEYWORDS = (" 주요 키워드는 ", "입니다.")
NO_ISSUES_HEADLINE = "에는 저장된 이슈가 없습니다"
NO_ISSUES_TEXT = "해당 기간에 수집된 이슈 그룹이 아직 없습니다."
PREVIOUS_DAY = "전날"
SHARE = " 분야의 비중이 컸습니다"
NO_SHARE = "특정 카테고리 쏠림은 크지 않았습니다"
NO_SHARE_WEEK = "주간 카테고리 흐름은 아직 충분히 쌓이지 않았습니다"
TOP = ("가장 주목할 이슈는 ", "입니다")
NO_TOP = "대표 이슈는 아직 정리되지 않았습니다"
TOP_WEEK = ("가장 반복적으로 확인된 이슈는 ", "입니다")
NO_TOP_WEEK = "반복적으로 확인된 대표 이슈는 아직 없습니다"
MERGED = ("을 포함해 같은 사건 흐름으로 보이는 ", "개 이슈가 함께 확인됐습니다. ")
MERGED_KEYWORDS = ("반복 키워드는 ", "입니다")
NO_MERGED_KEYWORDS = "반복 키워드는 아직 충분하지 않습니다"
RELATED_TITLE = "관련 이슈"
WEEK_EMPTY_HEADLINE = " 주간 요약 준비 중"
WEEK_EMPTY_TEXT = "해당 주간에 생성된 일간 요약이 아직 없습니다."


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def body_start(content: Column) -> Column:
    """The first 900 characters of the body, null where it is blank: all that summaries read of it."""
    return F.when(~is_blank(content), content.substr(1, 900))


def seed_of(body: Column, summary: Column) -> Column:
    """`seed_summary` of a body that is cut already (`body_start`)."""
    return F.coalesce(body.substr(1, 700), summary)


def brief_of(body: Column, summary: Column, articles: Column) -> Column:
    """`brief_summary` of a body that is cut already (`body_start`)."""
    return F.coalesce(body, summary, F.concat(articles.cast("string"), F.lit(RELATED_FALLBACK)))


def seed_summary(content: Column, summary: Column) -> Column:
    """The first 700 characters of the body, else the feed summary."""
    return seed_of(body_start(content), summary)


def brief_summary(content: Column, summary: Column, articles: Column) -> Column:
    """The first 900 characters of the body, else the feed summary; a count when there is no article at all."""
    return brief_of(body_start(content), summary, articles)


def safe_summary(feed_summary: Column, articles: Column, sources: Column) -> Column:
    """A cut feed summary, else a count sentence. Body text never shows here."""
    cleaned = clean_text(feed_summary)
    counted = _text(articles.cast("string"), SAFE_FALLBACK[0], sources.cast("string"), SAFE_FALLBACK[1])
    cut = F.concat(F.trim(cleaned.substr(1, 220)), F.lit("..."))
    return F.when(cleaned == "", counted).when(F.length(cleaned) > 220, cut).otherwise(cleaned)


def category_sentence(title: Column, issues: Column, keywords: Column) -> Column:
    tail = F.when(F.size(keywords) == 0, F.lit("")).otherwise(
        _text(LEAD_KEYWORDS[0], F.array_join(F.slice(keywords, 1, 4), ", "), LEAD_KEYWORDS[1]))
    return _text(title, LEAD, issues.cast("string"), LEAD_COUNT, tail)


def daily_headline(day: Column, issues: Column) -> Column:
    return F.when(issues == 0, _text(day_key(day), NO_ISSUES_HEADLINE)).otherwise(
        _text(day_key(day), f" {PREVIOUS_DAY} 주요 이슈 ", issues.cast("string"), "건"))


def daily_narrative(categories: Column, top_title: Column) -> Column:
    """`categories` are names in order; `top_title` is null when there is no top issue."""
    share = F.when(F.size(categories) == 0, F.lit(NO_SHARE)).otherwise(
        _text(F.array_join(F.slice(categories, 1, 3), ", "), SHARE))
    top = F.coalesce(_text(TOP[0], top_title, TOP[1]), F.lit(NO_TOP))
    return _text(share, ". ", top, f". 아래 주요 이슈를 훑으면 {PREVIOUS_DAY} 뉴스 흐름을 빠르게 파악할 수 있습니다.")


def merged_title(title: Column, keywords: Column) -> Column:
    named = F.when(F.size(keywords) == 0, F.lit(RELATED_TITLE)).otherwise(
        _text(F.array_join(F.slice(keywords, 1, 3), " "), f" {RELATED_TITLE}"))
    return F.when(clean_text(title) != "", clean_text(title)).otherwise(named)


def merged_summary(title: Column, parts: Column, keywords: Column) -> Column:
    tail = F.when(F.size(keywords) == 0, F.lit(NO_MERGED_KEYWORDS)).otherwise(
        _text(MERGED_KEYWORDS[0], F.array_join(F.slice(keywords, 1, 6), ", "), MERGED_KEYWORDS[1]))
    return _text(title, MERGED[0], parts.cast("string"), MERGED[1], tail, ".")


def weekly_category_sentence(title: Column, category: Column, issues: Column, articles: Column) -> Column:
    counts = _text(issues.cast("string"), "개 이슈와 ", articles.cast("string"), "개 기사가 확인됐습니다.")
    return F.coalesce(_text(clean_or_null(title), " 이슈를 중심으로 ", counts), _text(category, " 분야에서 ", counts))


def clean_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), clean_text(c))


def week_range(start: Column, end: Column) -> Column:
    return _text(day_key(start), "~", day_key(end))


def weekly_headline(start: Column, end: Column, issues: Column) -> Column:
    return _text(week_range(start, end), " 주간 주요 이슈 ", issues.cast("string"), "건")


def weekly_narrative(days: Column, categories: Column, top_title: Column) -> Column:
    share = F.when(F.size(categories) == 0, F.lit(NO_SHARE_WEEK)).otherwise(
        _text(F.array_join(F.slice(categories, 1, 3), ", "), SHARE))
    top = F.coalesce(_text(TOP_WEEK[0], top_title, TOP_WEEK[1]), F.lit(NO_TOP_WEEK))
    return _text(days.cast("string"), "개 일간 요약을 바탕으로 정리했습니다. ", share, ". ", top, ".")


def local_category_sentence(category: Column, issues: Column, top_title: Column) -> Column:
    return _text(category, "에서 ", count_phrase(issues), "개 이슈가 확인됐습니다. 현재 가장 주목도가 높은 이슈는 ",
                 or_empty(top_title), "입니다.")


def local_week_sentence(label: Column, category: Column, issues: Column, sources: Column, top_title: Column) -> Column:
    return _text(label, " 동안 ", category, " 카테고리에서는 ", count_phrase(issues), "개 이슈가 확인됐고, ",
                 count_phrase(sources), "개 출처에서 관련 흐름이 포착됐습니다. 가장 주목도가 높은 흐름은 ",
                 or_empty(top_title), "입니다.")
