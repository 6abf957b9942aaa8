"""From similar articles to issue groups."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from issueloom.functions.narrative import body_start, brief_of, brief_summary, seed_of
from issueloom.functions.signals import impact, is_low_value
from issueloom.functions.text import is_blank
from issueloom.operators.categorize import categorize
from issueloom.operators.dedupe import effective_members, group_sources, newest_first
from issueloom.operators.selection import greedy_select, rank_rows
from issueloom.operators.similarity import centroids, similar_pairs, with_blocks
from issueloom.rules import CATEGORY_RULES, DEFAULT_CATEGORY, GROUP_THRESHOLD
from issueloom.session import materialize


def finalize_groups(members: DataFrame, articles: DataFrame, rules=CATEGORY_RULES, default: str = DEFAULT_CATEGORY
                    ) -> tuple[DataFrame, DataFrame]:
    """(groups, members) with counts, sources, seed text, score and category, repeats removed.

    A group whose articles are all excluded is gone. Hot groups are safe: every step is an aggregate with a
    map-side half, and bodies are joined only for the one seed article of each group.
    """
    effective = effective_members(members, articles)
    summary = effective.groupBy("group_id").agg(
        F.count("*").cast("int").alias("article_count"), F.max("published_at").alias("latest_published_at"),
        F.min("order_key")["id"].alias("seed_id"))
    seeds = articles.select(F.col("id").alias("seed_id"), F.col("title").alias("seed_title"),
                            F.col("summary").alias("feed_summary"), body_start(F.col("content")).alias("body"))
    kept = effective.select("group_id", "article_id")
    groups = (
        summary.join(seeds, "seed_id").join(group_sources(effective), "group_id", "left")
        .withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
        .withColumn("score", impact(F.col("article_count"), F.size("sources"),
                                    is_low_value(F.col("seed_title"), F.col("sources"))))
        .withColumn("seed_summary", seed_of(F.col("body"), F.col("feed_summary")))
        .withColumn("summary", brief_of(F.col("body"), F.col("feed_summary"), F.col("article_count")))
        .join(categorize(kept, articles, rules, default), "group_id")
        .select("group_id", "category", "article_count", "sources", "latest_published_at", "score", "seed_title",
                "seed_summary", F.col("seed_title").alias("representative_title"), "summary")
    )
    return groups, kept


def fill_group_text(groups: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fill blank titles and summaries of groups from their first article.

    `seeds` holds (group_id, content, feed_summary) of the first article still present.
    """
    return groups.join(seeds, "group_id", "left").select(
        *[c for c in groups.columns if c not in ("representative_title", "summary")],
        F.when(is_blank(F.col("representative_title")), F.col("seed_title")).otherwise(F.col("representative_title"))
        .alias("representative_title"),
        F.when(is_blank(F.col("summary")), brief_summary(F.col("content"), F.col("feed_summary"), F.col("article_count")))
        .otherwise(F.col("summary")).alias("summary"))


def first_articles(members: DataFrame, articles: DataFrame) -> DataFrame:
    """The newest article of every group: (group_id, content, feed_summary)."""
    keyed = articles.select("id", "published_at", "first_seen_at")
    first = (members.join(keyed, F.col("article_id") == F.col("id"))
             .groupBy("group_id").agg(F.min(newest_first("article_id"))["id"].alias("id")))
    return first.join(articles.select("id", "content", F.col("summary").alias("feed_summary")), "id").drop("id")


def vector_nodes(articles: DataFrame, window: Column | None = None, hashed: bool = False, stored: bool = False) -> DataFrame:
    """(window, id, rank, vector, blocks) of the articles that can be grouped, ranked newest first per window.

    Without a window every article may meet every other one. Vectors are worked out once (`stored`: they lie in a table already
    and are not written again), and only narrow columns are ranked.
    """
    made = articles.filter(~F.col("is_excluded")).select(
        (window if window is not None else F.lit(0)).alias("window"), "id", "published_at", "first_seen_at", F.col("embedding").alias("vector"))
    made = (made if stored else materialize(made, "vectors")).filter(F.size("vector") > 0)
    ranked = rank_rows(made.drop("vector"), "window", [F.desc("published_at"), F.desc("first_seen_at"), F.asc("id")])
    nodes = made.select("window", "id", "vector").join(ranked.select("window", "id", "rank"), ["window", "id"])
    return materialize(with_blocks(nodes.select("window", "id", "rank", "vector"), hashed), "nodes")


def group_issues(articles: DataFrame, threshold: float = GROUP_THRESHOLD, window: Column | None = None,
                 nodes: DataFrame | None = None) -> DataFrame:
    """(window, article_id, leader_id, score): articles under the leader they are most like; every node is in one row.

    Newest first, an article leads unless an earlier leader reaches the threshold; the others join the best earlier
    leader, the earliest on a tie. Copies of a vector that is near itself can never lead, so such a group is one node
    here however large it is. A vector too short to be near itself (a text without tokens) is not folded: each leads.
    """
    nodes = vector_nodes(articles, window) if nodes is None else nodes
    twin = [F.xxhash64("vector"), F.hash("vector")]
    near_itself = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 9) >= threshold
    foldable = nodes.filter(near_itself)
    firsts = foldable.groupBy("window", *[c.alias(f"_h{i}") for i, c in enumerate(twin)]).agg(F.min("rank").alias("rank"))
    distinct = foldable.join(firsts.select("window", "rank"), ["window", "rank"], "left_semi").unionByName(
        nodes.filter(~near_itself))
    # whether a node is near one that is kept is told by the best pair of each task
    leaders = greedy_select(distinct, lambda probe, index: similar_pairs(probe, index, threshold, most=None if probe is index else 1))
    leaders = materialize(leaders, "leaders")
    rest = nodes.join(leaders.select("window", "id"), ["window", "id"], "left_anti")
    best = materialize(similar_pairs(rest, leaders, threshold, most=1).groupBy("window", "later")
                       .agg(F.max(F.struct("score", (-F.col("earlier_rank")).alias("order"), "earlier")).alias("b")), "best")
    joined = best.select("window", F.col("later").alias("article_id"), F.col("b.earlier").alias("leader_id"),
                         F.col("b.score").alias("score"))
    # with hashed blocks a copy may miss its leader; it then leads itself and is not lost
    alone = rest.join(best.select("window", F.col("later").alias("id")), ["window", "id"], "left_anti")
    own = leaders.select("window", "id").unionByName(alone.select("window", "id"))
    return joined.unionByName(own.select("window", F.col("id").alias("article_id"), F.col("id").alias("leader_id"),
                                         F.lit(1.0).alias("score")))


MARGIN = 0.05  # means this far below the threshold are still told from each other


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _meet_means(nodes: DataFrame, means: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(window, article_id, best, best_score, other): the mean each article is most like, if one reaches the threshold, and a
    bound on what any mean but its own reaches, by the two best; no mean at all within the margin counts as one at its edge."""
    both = with_blocks(nodes.select("window", "id", "rank", "vector", F.lit(0).alias("side")).unionByName(
        means.select("window", "id", F.lit(0).cast("bigint").alias("rank"), "vector", F.lit(1).alias("side"))))
    both = materialize(both, "refine")
    pairs = similar_pairs(both.filter("side = 0"), both.filter("side = 1"), threshold - margin, ordered=False, most=2)
    order = Window.partitionBy("window", "later").orderBy(F.desc("score"), F.desc("earlier"))
    two = pairs.withColumn("turn", F.row_number().over(order)).filter("turn <= 2")
    top = two.groupBy("window", F.col("later").alias("article_id")).agg(
        F.max(F.struct("score", "earlier")).alias("one"), F.max(F.when(F.col("turn") == 2, F.col("score"))).alias("two"))
    return top.select("window", "article_id", F.when(F.col("one.score") >= threshold, F.col("one.earlier")).alias("best"),
                      F.col("one.score").alias("best_score"), F.coalesce("two", F.lit(threshold - margin)).alias("second"))


def refine_groups(grouped: DataFrame, nodes: DataFrame, articles: DataFrame, threshold: float = GROUP_THRESHOLD,
                  passes: int = 1, margin: float = MARGIN) -> DataFrame:
    """Move each article to the group whose mean vector it is most like, `passes` times.

    An article that reaches no mean stays where it is. Means are plain averages: the mean of a loose group is
    short, and harder to reach. From the second pass on an article meets the means of its window only if it may move. No
    score of a unit vector changes by more than its mean has moved, so what the other means reached before and the largest move
    of the window bound what they reach now; an article whose own mean is still above that bound stays without asking.
    """
    state = materialize(grouped.select("window", "article_id", "leader_id", "score", F.lit(None).cast("double").alias("other")), "groups")
    old = None
    for _ in range(passes):
        members = state.select(F.col("leader_id").alias("group_id"), "article_id")
        windows = state.select("leader_id", "window").distinct()
        means = materialize(centroids(members, articles).withColumnRenamed("group_id", "id").join(
            windows.withColumnRenamed("leader_id", "id"), "id"), "means")
        if old is None:
            asked = state.withColumn("own", F.lit(None).cast("double"))
        else:
            moved = means.join(old.select("window", "id", F.col("vector").alias("was")), ["window", "id"]).groupBy("window").agg(
                F.max(F.sqrt(F.aggregate(F.zip_with("vector", "was", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))).alias("moved"))
            own = (state.join(nodes.select("window", F.col("id").alias("article_id"), "vector"), ["window", "article_id"])
                   .join(means.select("window", F.col("id").alias("leader_id"), F.col("vector").alias("mean")), ["window", "leader_id"])
                   .select("window", "article_id", F.round(_dot("vector", "mean"), 9).alias("own")))
            # vectors that were given, not made here, may be longer than one: the bound grows with them
            length = nodes.select("window", F.sqrt(_dot("vector", "vector")).alias("n")).groupBy("window").agg(F.max("n").alias("long"))
            asked = state.join(own, ["window", "article_id"], "left").join(moved, "window", "left").join(length, "window", "left").withColumn(
                "other", F.col("other") + F.coalesce("moved", F.lit(0.0)) * F.coalesce("long", F.lit(1.0)) + 1e-9).drop("moved", "long")
        asked = materialize(asked, "bounds")
        above = (F.col("own") >= threshold) & (F.col("own") > F.col("other"))
        below = (F.col("own") < threshold) & (F.col("other") < threshold)
        may_move = ~F.coalesce(above | below, F.lit(False))
        probes = nodes.join(asked.filter(may_move).select("window", F.col("article_id").alias("id")), ["window", "id"], "left_semi")
        met = _meet_means(probes, means, threshold, margin)
        joined = asked.join(met, ["window", "article_id"], "left")
        here = F.coalesce(F.col("best"), F.col("leader_id"))
        # of the two best the other one, seen from the mean the article is with now
        rival = F.when(F.col("best").isNotNull(), F.col("second")).otherwise(F.coalesce("best_score", F.lit(threshold - margin)))
        state = materialize(joined.select(
            "window", "article_id", here.alias("leader_id"),
            F.when(may_move, F.when(F.col("best").isNotNull(), F.col("best_score")).otherwise(F.col("score")))
            .when(above, F.col("own")).otherwise(F.col("score")).alias("score"),
            F.when(may_move, rival).otherwise(F.col("other")).alias("other")), "groups")
        old = means
    return state.drop("other")


def as_members(grouped: DataFrame) -> DataFrame:
    """Group ids that stay the same from run to run: the hash of the leading article's id."""
    return grouped.select(F.sha2("leader_id", 256).alias("group_id"), "article_id")
