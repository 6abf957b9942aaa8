"""Shuffles of the daily chain: texts that are cut first, words that stay where their group is."""

import re
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from issueloom.operators.dedupe import effective_members
from issueloom.operators.grouping import finalize_groups
from issueloom.operators.keywords import keyword_distribution, keyword_weights

BLANKS = " " * 950 + "late body"


def tables(spark, tmp_path):
    """Twelve groups of eight or nine articles, read from files."""
    rows, members = [], []
    for i in range(100):
        g = i % 12
        rows.append((f"a{i}", f"title{i} common", "wire" + str(i % 3), f"desk{i}", BLANKS if i % 5 == 4 else f"body{i} word{g} common " * 60,
                     f"summary{i} short", i % 9 == 0, datetime(2024, 1, 1 + i % 20), datetime(2024, 1, 1 + i % 20)))
        members.append((f"g{g}", f"a{i}"))
    spark.createDataFrame(rows, "id string, title string, source string, author string, content string, summary string, is_excluded boolean, "
                                "published_at timestamp, first_seen_at timestamp").write.parquet(f"{tmp_path}/articles")
    spark.createDataFrame(members, "group_id string, article_id string").write.parquet(f"{tmp_path}/members")
    return spark.read.parquet(f"{tmp_path}/articles"), spark.read.parquet(f"{tmp_path}/members")


def test_words_stay_with_their_group(spark, tmp_path):
    articles, members = tables(spark, tmp_path)
    groups, kept = finalize_groups(members, articles, [("all", ["common"])])
    groups.write.parquet(f"{tmp_path}/groups")
    groups = spark.read.parquet(f"{tmp_path}/groups").withColumn("period", F.to_date("latest_published_at"))
    effective = effective_members(kept, articles)
    plain = keyword_weights(groups, effective, articles)
    labelled = keyword_weights(groups, effective, articles, ("period", "category"))
    for weights in (plain, labelled):
        plan = weights._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*keyword", plan)
    assert {tuple(r) for r in labelled.drop("labels").collect()} == {tuple(r) for r in plain.collect()}
    totals = Counter({tuple(r[:3]): r[3] for r in keyword_distribution(plain, groups).collect()})
    assert totals and totals == Counter({tuple(r[:3]): r[3] for r in keyword_distribution(labelled).collect()})
    # every row of a repeated group keeps its label, as in a join
    twice = groups.unionByName(groups.limit(1).withColumn("category", F.lit("other")))
    both = keyword_weights(twice, effective, articles, ("period", "category"))
    assert both.count() == both.select("group_id", "keyword").distinct().count()
    assert {tuple(r) for r in keyword_distribution(both).collect()} == {
        tuple(r) for r in keyword_distribution(keyword_weights(twice, effective, articles), twice).collect()}


def test_seed_bodies_are_cut_before_they_are_joined(spark, tmp_path):
    articles, members = tables(spark, tmp_path)
    groups, _ = finalize_groups(members, articles, [("all", ["common"])])
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Project \[[^\n]*AS seed_id[^\n]*[ ,]content#\d+", plan.replace("(content#", "("))
    texts = {r.title: r.content for r in articles.collect()}
    found = [(texts[r.seed_title], r.seed_summary, r.summary) for r in groups.collect()]
    assert all((seed, summary) == (body[:700], body[:900]) for body, seed, summary in found)
    assert any(body == BLANKS for body, _, _ in found)
