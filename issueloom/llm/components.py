"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from issueloom.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours on the least of them and the node itself; `large`: only neighbours above the node.

    The least neighbour is a partial aggregate, and the join back on a hot node is one that AQE can split.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = edges.join(least, "a")
    out = hung.filter("b > a") if large else hung
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def component_roots(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b): root is the least node that it can reach.

    Self-loops and repeated edges are allowed and add nothing. The edges are rewritten until they no longer change,
    in a number of rounds that grows with the logarithm of their count; each round is a written table.
    """
    above = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialize(edges.filter("a <> b").select(*above).distinct(), label)
    mark = None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
        now = materialize(_stars(_stars(now, True), False), label)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
