"""Exact top-k by integer inner product, with block-at-a-time pruning.

Vectors are put in an order that keeps like ones together, and cut into blocks of consecutive ones. A block is stored forward
(its vectors) with the largest and least value of every component. For a query these give a bound of any score in
the block; blocks are scored in the order of their bounds until the bound falls below the query's k-th score.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from issueloom.session import materialize

BLOCK_ROWS = 256
PIVOTS, PIVOT_SAMPLE = 64, 4096  # the order is fitted on so many vectors; it decides speed, never results
PACK_BLOCKS = 64  # the queries of so many neighbouring blocks travel and are scored together
PAGE_BLOCKS = 512  # block bounds that one task compares with groups of queries
HAND_PACKS = 32
TASK_BLOCKS = 128  # blocks that one task scores for one group of queries


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as longs. Rows without an id, without a vector, or with a null or
    non-finite component are left out. A vector shorter than another counts as filled up with zeros."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _pivots(vectors: DataFrame, width: int) -> np.ndarray:
    """A few rounds of k-means on a sample of bounded size, taken by a hash of the ids.

    A threshold of the hash lets through about twice the sample before anything is put in order: the first rows of an order
    are gathered from every partition.
    """
    share = max(1, vectors.count() // (2 * PIVOT_SAMPLE))
    some = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(10)), F.lit(share)) == 0)
    rows = some.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()
    x = _matrix([r["v"] for r in rows], width).astype(float)
    centres = x[:PIVOTS].copy()
    for _ in range(5):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    return centres


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: by doubles where these are exact, else by longs."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    return queries @ vectors.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query (row) can score in each block (column): summed term maxima."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return _products(plus, high) + _products(minus, low)


def blocks_of(vectors: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, n, least_id, ids, data, high, low): the index. Every vector is in it, in blocks of up to `block_rows`."""
    centres = _pivots(vectors, width)

    def place(batches):
        for rows in batches:
            x = _matrix(rows["v"], width).astype(float)
            gap = (centres**2).sum(axis=1) - 2 * x @ centres.T if len(centres) else np.zeros((len(x), 1))
            yield rows.assign(pivot=np.argmin(gap, axis=1).astype(np.int32), near=gap.min(axis=1))

    placed = materialize(vectors.mapInPandas(place, "vec_id bigint, v array<bigint>, pivot int, near double"), "topk-order")
    # equal vectors are spread by their ids, so that no value of the order fills a task
    ranged = placed.repartitionByRange("pivot", "near", "vec_id").sortWithinPartitions("pivot", "near", "vec_id")

    def cut(batches):
        for rows in batches:
            for at in range(0, len(rows), block_rows):
                part = rows.iloc[at:at + block_rows]
                x = _matrix(part["v"], width)
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy().tobytes()], "data": [x.tobytes()],
                                    "high": [x.max(axis=0).tobytes()], "low": [x.min(axis=0).tobytes()]})

    made = ranged.mapInPandas(cut, "ids binary, data binary, high binary, low binary")
    return materialize(made.withColumn("block", F.monotonically_increasing_id()), "topk-blocks")


def _longs(data: bytes, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(data, np.int64)
    return out if width is None else out.reshape(-1, width)


class _Search:
    """The k best so far of a group of queries."""

    def __init__(self, pack, width: int, k: int, block_rows: int):
        self.width, self.k, self.block_rows = width, k, block_rows
        self.queries, self.own = _longs(pack["data"], width), _longs(pack["own"])
        self.ids, self.scores, self.places = (
            _longs(pack[c]).reshape(-1, k).copy() for c in ("best_ids", "best_scores", "best_places"))

    def look(self, blocks: pd.DataFrame) -> "_Search":
        """Score blocks in the order of their bounds; a query passes over those whose bound is below its k-th score."""
        if not len(blocks) or not len(self.queries):
            return self
        high, low = (np.stack([_longs(b) for b in blocks[c]]) for c in ("high", "low"))
        bounds = _bounds(self.queries, high, low)
        for at in np.argsort(-bounds.max(axis=0), kind="stable"):
            live = np.flatnonzero(bounds[:, at] >= self.scores[:, -1])
            if not len(live):
                if bounds[:, at].max() < self.scores[:, -1].min():
                    break
                continue
            ids = _longs(blocks["ids"].iloc[at])
            scores = _products(self.queries[live], _longs(blocks["data"].iloc[at], self.width))
            rows = blocks["block"].iloc[at] * self.block_rows + np.arange(len(ids))
            for q, line in zip(live, scores):
                near = np.flatnonzero((line >= self.scores[q, -1]) & (rows != self.own[q]))
                if len(near):
                    every_id, every = np.append(self.ids[q], ids[near]), np.append(self.scores[q], line[near])
                    order = np.lexsort((every_id, -every))[:self.k]
                    self.ids[q], self.scores[q] = every_id[order], every[order]
                    self.places[q] = np.append(self.places[q], rows[near])[order]
        return self

    def rows(self, pack) -> pd.DataFrame:
        out = pd.DataFrame({"own": np.repeat(self.own, self.k), "query_id": np.repeat(_longs(pack["query_ids"]), self.k),
                            "vec_id": self.ids.ravel(), "score": self.scores.ravel(), "place": self.places.ravel()})
        return out[out["score"] > NOTHING]


NOTHING = -(2**63) + 1  # the score of a place that is still free
PACK = "pack bigint, query_ids binary, own binary, data binary, best_ids binary, best_scores binary, best_places binary"
FOUND = "own bigint, query_id bigint, vec_id bigint, score bigint, place bigint"


def _pack_queries(blocks: DataFrame, width: int, k: int, every: int, block_rows: int) -> DataFrame:
    """Queries of PACK_BLOCKS neighbouring blocks in one row, with free places for their k best."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        ids, own, data = [], [], []
        for r in rows.itertuples():
            mine = np.flatnonzero(_longs(r.ids) % every == 0)
            ids.append(_longs(r.ids)[mine])
            own.append(r.block * block_rows + mine)
            data.append(_longs(r.data, width)[mine])
        n = sum(map(len, ids))
        if not n:
            return pd.DataFrame(columns=[c.split()[0] for c in PACK.split(", ")])
        return pd.DataFrame({
            "pack": [rows["pack"].iloc[0]], "query_ids": [np.concatenate(ids).tobytes()],
            "own": [np.concatenate(own).astype(np.int64).tobytes()], "data": [np.concatenate(data).tobytes()],
            "best_ids": [np.full(n * k, 2**63 - 1, np.int64).tobytes()], "best_scores": [np.full(n * k, NOTHING, np.int64).tobytes()],
            "best_places": [np.full(n * k, -1, np.int64).tobytes()]})
    return blocks.select("pack", "block", "ids", "data").groupBy("pack").applyInPandas(pack, PACK)


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by `every`.

    Scores are inner products of whole numbers; ties go to the smaller vec_id; a row is never its own result, but
    another row of the same vec_id can be. Fewer rows than k give fewer ranks; an empty table or one without a query
    gives none. Scores are exact as long as they fit a long.
    """
    spark = vectors.sparkSession
    whole = materialize(vectors, "topk-vectors")
    width = whole.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = max(width, 1)
    blocks = blocks_of(whole, width, block_rows).withColumn("pack", F.expr(f"block div {PACK_BLOCKS}"))
    count = blocks.count()

    # each group of queries first meets the blocks it comes from, which gives it a k-th score to prune by
    def home(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left
        pack = left.iloc[0]
        found = _Search(pack, width, k, block_rows).look(right)
        return left.assign(best_ids=[found.ids.tobytes()], best_scores=[found.scores.tobytes()],
                           best_places=[found.places.tobytes()])

    packs = materialize(
        _pack_queries(blocks, width, k, every, block_rows).groupBy("pack").cogroup(blocks.groupBy("pack")).applyInPandas(home, PACK), "topk-packs")

    # bounds of all other blocks, a page of blocks and a few packs at a time; only blocks that some query may still need go on
    pages, hands = -(-count // PAGE_BLOCKS), max(1, -(-packs.count() // HAND_PACKS))
    page, hand = F.pmod(F.xxhash64("block"), F.lit(pages)), F.pmod(F.xxhash64("pack"), F.lit(hands))

    def each(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    paged = blocks.select("pack", "block", "high", "low", page.alias("page"), each(hands).alias("hand"))
    asked = packs.withColumn("hand", hand).withColumn("page", each(pages))

    def bound(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            high, low = (np.stack([_longs(b) for b in right[c]]) for c in ("high", "low"))
            for pack in left.itertuples():
                most = _bounds(_longs(pack.data, width), high, low)
                kth = _longs(pack.best_scores).reshape(-1, k)[:, -1]
                open_ = (most >= kth[:, None]).any(axis=0) & (right["pack"] != pack.pack).to_numpy()
                out.append(pd.DataFrame({"pack": pack.pack, "block": right["block"].to_numpy()[open_]}))
        return pd.concat(out) if out else pd.DataFrame({"pack": pd.Series(dtype="int64"), "block": pd.Series(dtype="int64")})

    open_blocks = materialize(
        asked.groupBy("hand", "page").cogroup(paged.groupBy("hand", "page")).applyInPandas(bound, "pack bigint, block bigint"), "topk-open")

    salts = -(-count // TASK_BLOCKS)
    salt = F.pmod(F.xxhash64("block", F.lit(1)), F.lit(salts)).alias("salt")
    work = open_blocks.join(blocks.drop("pack"), "block").select("pack", salt, "block", "ids", "data", "high", "low")
    several = packs.withColumn("salt", each(salts))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")], dtype="int64")
        pack = left.iloc[0]
        return _Search(pack, width, k, block_rows).look(right).rows(pack)

    found = several.groupBy("pack", "salt").cogroup(work.groupBy("pack", "salt")).applyInPandas(search, FOUND)
    # each task starts from the results of the home blocks, so these come back several times
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["own", "place"]).withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
