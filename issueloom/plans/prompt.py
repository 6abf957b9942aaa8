"""The text a summary is handed to an external writer as."""

from pyspark.sql import Column, DataFrame, functions as F

from issueloom.functions.text import compact

CATEGORIES, ISSUES, SOURCES, KEYWORDS, EVIDENCE = 8, 12, 4, 8, 2


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _listed(items: Column, n: int, none: str) -> Column:
    return F.when(F.size(items) == 0, F.lit(none)).otherwise(F.array_join(F.slice(items, 1, n), ", "))


def render_prompt(summaries: DataFrame, evidence: DataFrame, period_label: str = "전날") -> DataFrame:
    """(date, prompt): totals, category shares, and the top issues with their evidence."""
    number = lambda c: c.cast("string")
    shown = (evidence.filter(F.col("pos") <= EVIDENCE).withColumn("line", _text(
        "- 근거 ", number(F.col("pos")), ": ", F.col("source"), "\n  제목: ", F.col("title"), "\n  RSS 요약: ",
        compact(F.col("summary"), 350), "\n  본문 일부: ", compact(F.col("excerpt"), 900)))
        .groupBy("date", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))),
                                                               lambda s: s["line"]), "\n").alias("evidence")))
    issues = (summaries.select("date", F.posexplode("top_issues").alias("i", "x")).filter(F.col("i") < ISSUES)
              .withColumn("place", F.col("i") + 1).join(shown, ["date", "place"], "left")
              .withColumn("line", _text(
                  number(F.col("place")), ". [", F.col("x.category"), "] ", F.col("x.title"), "\n기사수: ",
                  number(F.col("x.article_count")), ", 점수: ", number(F.col("x.score")), ", 출처: ",
                  _listed(F.col("x.sources"), SOURCES, "출처 없음"), "\n주요 키워드: ",
                  _listed(F.col("x.keywords"), KEYWORDS, "키워드 없음"), "\n기존 요약: ", F.col("x.summary"),
                  "\n근거 기사:\n", F.coalesce("evidence", F.lit("근거 기사 없음"))))
              .groupBy("date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))),
                                                            lambda s: s["line"]), "\n\n").alias("issues")))
    shares = F.array_join(F.transform(F.slice("categories", 1, CATEGORIES), lambda c: _text(
        "- ", c["category"], ": 이슈 ", number(c["issue_count"]), "건, 기사 ", number(c["article_count"]), "건")), "\n")
    return summaries.join(issues, "date", "left").select("date", _text(
        f"요약 대상: {period_label}\n기간 키: ", F.col("date"), "\n전체 이슈 수: ", number(F.col("issue_count")),
        "\n전체 기사 수: ", number(F.col("article_count")), "\n전체 출처 수: ", number(F.col("source_count")),
        "\n\n카테고리 분포:\n", shares, "\n\n주요 이슈:\n", F.coalesce("issues", F.lit(""))).alias("prompt"))
