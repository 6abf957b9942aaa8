"""First come, first kept: the order-exact selection behind issue grouping and issue de-duplication.

Nodes are taken in rank order; a node stays unless an earlier node that stayed is its neighbour. One after the
other this is a scan; here it runs as a few rounds of joins over all windows at once, with the same answer.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from issueloom.session import materialize

PLAIN_WINDOW_ROWS = 1_000_000  # a window up to this size is ranked by one sort
FINISH_EDGES = 20_000_000  # edges of one window that one task may finish
FINISH_ROWS, FINISH_TASKS = 100_000, 64  # edges a task, as far as windows can be told apart; tasks at most
FIRST_BATCH = 2048

Neighbours = Callable[[DataFrame, DataFrame], DataFrame]


def rank_rows(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Add `rank`, 1.. per `by`. `order` must end in a unique column.

    Beyond a size limit the rows are range-partitioned, numbered inside each slice, and shifted by the sizes of
    the slices before, so that no value of `by` has to fit one task.
    """
    largest = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    if largest <= PLAIN_WINDOW_ROWS:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint"))
    sliced = materialize(
        df.repartitionByRange(F.col(by), *order).withColumn("_slice", F.spark_partition_id()), "slices")
    sizes = sliced.groupBy(by, "_slice").count()
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(by, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(by, "_slice").orderBy(*order))
    return (sliced.withColumn("_local", local).join(shifts, [by, "_slice"])
            .withColumn("rank", F.col("_local") + F.col("_shift")).drop("_slice", "_local", "_shift"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plain scan over edges (window, later, order, earlier), sorted by window and order: what is held are nodes, not edges."""
    window, known, lost = None, {}, np.zeros(0, bool)
    for batch in batches:
        kind = batch.column(1).type
        out = []
        for at in _runs(batch.column(0)):
            part = batch.slice(at[0], at[1] - at[0])
            if (here := part.column(0)[0].as_py()) != window:
                window, known, lost = here, {}, np.zeros(0, bool)
            later, earlier = part.column(1), part.column(3)
            if pa.types.is_integer(kind):  # ranks
                ends = [x.to_numpy(zero_copy_only=False) for x in (later, earlier)]
            else:
                ends = [np.array([known.setdefault(v, len(known)) for v in x.to_pylist()], np.int64) for x in (later, earlier)]
            need = int(max(ends[0].max(), ends[1].max())) + 1
            if need > len(lost):
                lost = np.append(lost, np.zeros(max(need, 2 * len(lost)) - len(lost), bool))
            cuts = np.flatnonzero(ends[0][1:] != ends[0][:-1]) + 1
            heads = [0, *cuts.tolist()]
            gone = []
            for low, high, node in zip(heads, [*heads[1:], len(ends[0])], ends[0][heads].tolist()):
                if not lost[node] and not lost[ends[1][low:high]].all():
                    lost[node] = True
                    gone.append(low)
            out.append(part.select([0, 1]).take(pa.array(gone, pa.int64())))
        for some in out:
            yield pa.RecordBatch.from_arrays(some.columns, ["window", "id"])


def _runs(column: pa.Array) -> list[tuple[int, int]]:
    """Stretches of equal values, one after the other."""
    ends = pc.run_end_encode(column, run_end_type=pa.int64()).run_ends.to_pylist()
    return list(zip([0, *ends], ends))


def dropped_nodes(edges: DataFrame) -> DataFrame:
    """(window, id) of the nodes that lose, from edges (window, later, later_rank, earlier); without later_rank the ends are ranks.

    A window of up to FINISH_EDGES edges is gone through in order by one task, which holds a bit for each node; larger ones
    lose edges in rounds of joins first.
    """
    order = "later_rank" if "later_rank" in edges.columns else "later"
    names = list(dict.fromkeys(["window", "later", order, "earlier"]))
    edges = materialize(edges.select(*names), "edges")
    parts = []
    while True:
        largest, every = edges.groupBy("window").count().agg(F.max("count"), F.sum("count")).first()
        if largest is None:
            break
        if largest <= FINISH_EDGES:
            tasks = max(1, min(FINISH_TASKS, -(-every // FINISH_ROWS)))
            ends = edges.select("window", "later", F.col(order).alias("_order"), "earlier").repartition(tasks, "window").sortWithinPartitions("window", "_order")
            schema = ", ".join(f"{n} {edges.schema[c].dataType.simpleString()}" for n, c in (("window", "window"), ("id", "later")))
            parts.append(materialize(ends.mapInArrow(_finish, schema), "dropped"))
            break
        # a node without an earlier undecided neighbour stays; its later neighbours go
        heads = edges.select("window", F.col("earlier").alias("id")).distinct().join(
            edges.select("window", F.col("later").alias("id")).distinct(), ["window", "id"], "left_anti")
        losers = materialize(
            edges.join(heads.withColumnRenamed("id", "earlier"), ["window", "earlier"], "left_semi")
            .select("window", F.col("later").alias("id")).distinct(), "dropped")
        parts.append(losers)
        for end in ("later", "earlier"):
            edges = edges.join(losers.withColumnRenamed("id", end), ["window", end], "left_anti")
        edges = materialize(edges.select(*names), "edges")
    if not parts:
        return edges.select("window", F.col("later").alias("id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ordered_select(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of `nodes` (window, id, rank, ..) that stay, given undirected `edges` (window, a, b), or (window, later_rank, earlier_rank).

    Edges of ranks need no joins and are a few bytes each; every id must have one rank then.
    """
    if "later_rank" in edges.columns:
        directed = edges.select("window", F.col("later_rank").alias("later"), F.col("earlier_rank").alias("earlier"))
        return nodes.join(dropped_nodes(directed).withColumnRenamed("id", "rank"), ["window", "rank"], "left_anti")
    ranks = nodes.select("window", "id", "rank")
    both = (edges.join(ranks.withColumnsRenamed({"id": "a", "rank": "ra"}), ["window", "a"])
            .join(ranks.withColumnsRenamed({"id": "b", "rank": "rb"}), ["window", "b"]))
    first = F.col("ra") < F.col("rb")
    directed = both.filter("ra <> rb").select(
        "window", F.when(first, F.col("b")).otherwise(F.col("a")).alias("later"),
        F.greatest("ra", "rb").alias("later_rank"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier"))
    return nodes.join(dropped_nodes(directed), ["window", "id"], "left_anti")


def greedy_select(nodes: DataFrame, neighbours: Neighbours, first_batch: int = FIRST_BATCH) -> DataFrame:
    """Rows of `nodes` (window, id, rank, ..) that stay, when edges come from `neighbours(probe, index)`.

    `neighbours` returns (window, later, later_rank, earlier) for probe rows and the index rows before them.
    Ranks are taken in doubling batches: each batch first loses what is near a node already kept, so a third of
    all rows being alike costs one comparison each, not one edge per pair.
    """
    last = nodes.agg(F.max("rank")).first()[0] or 0
    kept, low, high = None, 0, first_batch
    while low < last:
        batch = nodes.filter((F.col("rank") > low) & (F.col("rank") <= high))
        if kept is not None:
            lost = neighbours(batch, kept).select("window", F.col("later").alias("id")).distinct()
            batch = materialize(batch.join(lost, ["window", "id"], "left_anti"), "batch")
        stay = batch.join(dropped_nodes(neighbours(batch, batch)), ["window", "id"], "left_anti")
        stay = stay if high >= last and kept is None else materialize(stay, "kept")
        kept = stay if kept is None else kept.unionByName(stay)
        low, high = high, high * 2
    return nodes if kept is None else kept
