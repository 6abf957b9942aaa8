"""Pairs of vectors whose dot product reaches a threshold.

Windows are compared whole, whatever their size: rows are cut into chunks and pairs of chunks are tasks of their own. Where a
window has several chunks, its rows are dealt to them along the angles they make with a few pivots, so that a chunk is a thin
slice of the space: two rows are no nearer than their angles to any pivot differ, and a pair of chunks whose angles are too far
apart holds no pair. It is never sent out; nothing is lost. A caller that prefers speed to completeness may ask for blocks by
bands of sign bits of fixed random projections; the size of the data never decides that.
"""

import math
from collections.abc import Iterator
from itertools import pairwise, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from issueloom.rules import GROUP_THRESHOLD
from issueloom.session import materialize

CHUNK_ROWS = 2000
TASK_ROWS = 20_000
TILE, TILES = 24, 24  # chunks along a side of a tile; tiles there are before they grow
MOST_TILES = 4096  # tiles that are tasks of their own
BITS, BANDS, SEED = 12, 80, 20240131
BLOCK_ROWS = 2000  # a hashed block of more rows is cut by further bits
MORE_BITS, WAYS, LEVELS = 4, 3, 4
PIVOTS, PIVOT_SAMPLE, SHELLS = 16, 2048, 64  # shells a radian


def projections(size: int, bits: int, bands: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, bits * bands))


def band_keys(bits: int, bands: int, seed: int):
    """Column function: vector -> one long per band, from the signs of its projections."""
    @pandas_udf("array<bigint>")
    def keys(vectors: pd.Series) -> pd.Series:
        matrix = np.stack(vectors.to_numpy())
        signs = (matrix @ projections(matrix.shape[1], bits, bands, seed)) > 0
        values = signs.reshape(len(matrix), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
        return pd.Series(list(values + (np.arange(bands, dtype=np.int64) << bits)))
    return keys


def with_blocks(nodes: DataFrame, hashed: bool = False, bits: int = BITS, bands: int = BANDS, seed: int = SEED,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `blocks` and `bands`: the window itself, or with `hashed` blocks that hold most similar pairs but not all.

    A hashed block is a band's bits. One of more than `block_rows` rows is cut by MORE_BITS further bits, in WAYS ways at
    once, as two rows that differ in one way may agree in another; and so on, LEVELS times. What is then still too large
    are rows that no projection tells apart. `blocks` are the keys a row is compared under; `bands` has its uncut bands in
    order, and numbers of its own in place of cut ones.
    """
    if not hashed:
        return nodes.withColumn("blocks", F.array(F.xxhash64("window"))).withColumn("bands", F.col("blocks"))
    signed = materialize(nodes.select(
        "window", "id", F.transform(band_keys(bits, bands, seed)(F.col("vector")), lambda k: F.xxhash64(F.col("window"), k)).alias("first"),
        band_keys(MORE_BITS, LEVELS * WAYS, seed + 1)(F.col("vector")).alias("more")).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # a row has hundreds of keys where blocks are cut often: it is known by its number until they are brought together
    keyed, parts, level = signed.select("row", F.explode("first").alias("key")), [], 0
    while True:
        crowded = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("key"), "crowded")
        if level == LEVELS or crowded.isEmpty():
            parts.append(keyed.withColumn("level", F.lit(level)))
            break
        parts.append(keyed.join(crowded, "key", "left_anti").withColumn("level", F.lit(level)))
        finer = F.explode(F.slice("more", level * WAYS + 1, WAYS))
        keyed = materialize(keyed.join(crowded, "key", "left_semi").join(signed.select("row", "more"), "row").select(
            "row", "key", finer.alias("bits")).select("row", F.xxhash64("key", "bits").alias("key")), "keyed")
        level += 1
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    lists = every.groupBy("row").agg(
        F.collect_list("key").alias("blocks"), F.collect_list(F.when(F.col("level") == 0, F.col("key"))).alias("uncut"))
    own = F.transform("first", lambda k, i: F.when(F.array_contains("uncut", k), k).otherwise(F.xxhash64("id", k, i)))
    # rows of an id that comes twice meet the lists of both
    named = signed.select("row", "window", "id").join(lists, "row").drop("row")
    return nodes.join(signed.select("window", "id", "first").join(named, ["window", "id"]).select(
        "window", "id", "blocks", own.alias("bands")), ["window", "id"])


SLAB = 1 << 20  # dot products, or places that share a key, held at once
ROWS_OUT = 100_000


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one tile at a time; rows come sorted by tile."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("block", "pt", "it")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for low, high in pairwise([0, *cuts.tolist(), batch.num_rows]):
            key = tuple(keys[:, low].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, length of each)."""
    return (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]),
            np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in column.chunks]))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values, lengths = _lists(column)
    if lengths.min() != lengths.max():
        raise ValueError("vectors of one window must be of one length")
    return values.reshape(len(lengths), lengths[0])


class _Blocks:
    """Keys of the rows of one chunk, in order of the keys."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.rows = len(lengths), keys[order], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order]

    def meet(self, other: "_Blocks") -> np.ndarray:
        """Which rows of either side share a key."""
        out = np.zeros((self.size, other.size), bool)
        first = np.searchsorted(other.keys, self.keys, "left")
        count = np.searchsorted(other.keys, self.keys, "right") - first
        known = np.flatnonzero(count)
        first, count, ends = first[known], count[known], np.cumsum(count[known])
        low = 0
        while low < len(known):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLAB)))
            n = count[low:high]
            at = np.repeat(first[low:high] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[np.repeat(self.rows[known[low:high]], n), other.rows[at]] = True
            low = high
        return out


def _reports(block: int, bands: np.ndarray, blocks: pa.Array, later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Whether this block is the one that reports each pair: the first uncut band they share, else the least block."""
    first = np.zeros(len(later), bool)
    for low in range(0, len(later), ROWS_OUT):
        part = slice(low, low + ROWS_OUT)
        a, b = later[part], earlier[part]
        shared = bands[a] == bands[b]
        mine = bands[a, shared.argmax(axis=1)] == block
        rest = np.flatnonzero(~shared.any(axis=1))
        keys = {k: set(blocks[k].as_py()) for k in np.unique(np.concatenate([a[rest], b[rest]])).tolist()}
        mine[rest] = [min(keys[x] & keys[y]) == block for x, y in zip(a[rest].tolist(), b[rest].tolist())]
        first[part] = mine
    return first


def _best(a: np.ndarray, b: np.ndarray, scores: np.ndarray, most: int, place: np.ndarray) -> np.ndarray:
    """Which pairs are among the `most` best of their probe row `a`, those of the least `place` on a tie."""
    order = np.lexsort((place[b], -scores, a))
    heads = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(a) else order
    turn = np.arange(len(a)) - np.repeat(heads, np.diff(np.append(heads, len(a))))
    return order[turn < most]


def _score_tiles(threshold: float, ordered: bool, same: bool, ids: bool, most: int | None, whole: bool):
    """Scores tiles, a slab of one pair of chunks at a time: what a task holds does not depend on how many pairs it finds.

    With `same` a row stands for both sides. With `whole` a tile is of windows, and pairs count only if they share a block.
    """
    def rows_out(columns, later, earlier, scores):
        for low in range(0, len(later), ROWS_OUT):
            x, y = pa.array(later[low:low + ROWS_OUT]), pa.array(earlier[low:low + ROWS_OUT])
            out = {"window": columns["window"].take(x)}
            for name, at in (("later", x), ("earlier", y)):
                if ids:
                    out[name] = columns["id"].take(at)
                out[f"{name}_rank"] = columns["rank"].take(at)
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(scores[low:low + ROWS_OUT])})

    def of_tile(tile):
        columns = {c: tile[c].combine_chunks() for c in tile.column_names if c in ("window", "id", "rank")}
        columns = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
        vectors, rank = _matrix(tile["vector"]), columns["rank"].to_numpy(zero_copy_only=False)
        side, chunk, mask, slot = (tile[c].to_numpy() for c in ("side", "chunk", "mask", "slot"))
        cuts = np.flatnonzero((side[1:] != side[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        runs = list(pairwise([0, *cuts.tolist(), len(side)]))
        hashed = not whole and tile["blocks"].null_count == 0
        bands = _matrix(tile["bands"]) if hashed else None
        blocks = tile["blocks"].combine_chunks() if hashed else None
        if whole:
            kept = {low: _Blocks(*_lists(tile["blocks"].slice(low, high - low))) for low, high in runs}
        if most is not None:
            place = rank if ordered else None
            if place is None:  # ranks may be equal: the greatest id is first then
                place = np.empty(len(rank), np.int64)
                place[pc.sort_indices(pa.table({"r": columns["rank"], "i": columns["id"]}), [("r", "ascending"), ("i", "descending")]).to_numpy()] = np.arange(len(rank))
        shares = {}

        def hits(low, at, high, run):
            """(a, b, scores) of the pairs of probe rows at .. of a chunk with the rows of another chunk."""
            i, j = run
            dots = vectors[at:high] @ vectors[i:j].T
            # few reach the threshold: only those are rounded and compared as the result is
            hit = dots >= threshold - 1e-8
            if whole:
                if (low, i) not in shares:
                    shares.clear()
                    shares[low, i] = kept[low].meet(kept[i])
                hit &= shares[low, i][at - low:high - low]
            flat = np.flatnonzero(hit)
            scores = np.round(dots.ravel()[flat], 9)
            a, b = np.divmod(flat[scores >= threshold], j - i)
            a, b, scores = a + at, b + i, scores[scores >= threshold]
            if same and i != low:
                a, b = np.where(rank[b] > rank[a], b, a), np.where(rank[b] > rank[a], a, b)
            kept_ones = rank[b] < rank[a] if ordered else np.ones(len(a), bool)
            if hashed:
                kept_ones[kept_ones] = _reports(tile["block"][0].as_py(), bands, blocks, a[kept_ones], b[kept_ones])
            return a[kept_ones], b[kept_ones], scores[kept_ones]

        for low, high in runs:
            met = [run for run in runs if mask[low] and slot[run[0]] >= 0 and mask[low] >> slot[run[0]] & 1]
            slabs = pairwise([*range(low, high, max(1, SLAB // max([1, *(j - i for i, j in met)]))), high])
            if most is None:
                for run, (at, stop) in product(met, slabs):
                    yield from rows_out(columns, *hits(low, at, stop, run))
                continue
            for at, stop in slabs:
                best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                for run in met:
                    a, b, scores = hits(low, at, stop, run)
                    if most == 1 and len(a):  # rows are in order: a first cut without sorting
                        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                        top = np.repeat(np.maximum.reduceat(scores, heads), np.diff(np.append(heads, len(a)))) == scores
                        a, b, scores = a[top], b[top], scores[top]
                    best = [np.concatenate(x) for x in zip(best, (a, b, scores))]
                    first = _best(*best, most, place)
                    best = [x[first] for x in best]
                yield from rows_out(columns, *best)

    def score(batches):
        for tile in _tiles(batches):
            yield from of_tile(tile)
    return score


def fit_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors spread over the directions of `sample`: far from each other first, then moved to the middle of what is near."""
    norms = np.linalg.norm(sample, axis=1)
    sample = sample[norms > 0] / norms[norms > 0, None]
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    pivots, near = [sample[0]], sample @ sample[0]
    while len(pivots) < min(count, len(sample)):
        pivots.append(sample[near.argmin()])
        near = np.maximum(near, sample @ pivots[-1])
    pivots = np.array(pivots)
    for _ in range(3):
        home = (sample @ pivots.T).argmax(axis=1)
        sums = np.array([sample[home == k].sum(axis=0) for k in range(len(pivots))])
        long = np.linalg.norm(sums, axis=1)
        pivots[long > 0] = sums[long > 0] / long[long > 0, None]
    return pivots


def angles(pivots: np.ndarray, cells: int):
    """Column function: vector -> (cell, shell, norm, angles): nearest of the first `cells` pivots, angle to it in steps,
    length, angles to all pivots."""
    @pandas_udf("cell int, shell int, norm double, angles array<double>")
    def place(vectors: pd.Series) -> pd.DataFrame:
        matrix = np.stack(vectors.to_numpy())
        norms = np.linalg.norm(matrix, axis=1)
        unit = np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=norms[:, None] > 0)
        every = np.arccos(np.clip(unit @ pivots.T, -1, 1))
        cell = every[:, :cells].argmin(axis=1)
        shell = (every[np.arange(len(cell)), cell] * SHELLS).astype(np.int32)
        return pd.DataFrame({"cell": cell.astype(np.int32), "shell": shell, "norm": norms, "angles": list(every)})
    return place


def _in_chunks(rows: DataFrame) -> DataFrame:
    """Add `chunk` in each block and side: consecutive shells of one cell, twice CHUNK_ROWS rows at most.

    Only counts of (cell, shell) are put in order; a shell of more rows than a chunk is cut by the hash of its ids. The counts
    are written: of known size, they are sent to the rows.
    """
    grain = ["block", "side", "cell", "shell"]
    counts = rows.groupBy(*grain).agg(F.count("*").alias("n"))
    before = Window.partitionBy("block", "side", "cell").orderBy("shell").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select(
        *grain, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.ceil(F.col("n") / CHUNK_ROWS).alias("cut")), "shells")
    spread = F.pmod(F.xxhash64("id", F.lit(7)), F.col("cut")) * CHUNK_ROWS
    step = F.floor((F.col("start") + spread) / CHUNK_ROWS)
    return rows.join(starts, grain).withColumn("chunk", step * PIVOTS + F.col("cell")).drop("start", "cut")


def _in_cells(chunk: str) -> Column:
    """Neighbours in one cell first."""
    return F.struct(F.col(chunk) % PIVOTS, F.col(chunk))


def meeting_chunks(chunked: DataFrame, pivots: int, threshold: float, ordered: bool = False, same: bool = False) -> DataFrame:
    """(block, p, i, probes, indexed, open) of all pairs of chunks; those not `open` hold no pair that reaches the threshold.

    With `same` the rows are both sides, and two chunks are one pair.

    For x and y of lengths up to a and b, x.y >= t needs an angle of at most acos(t / ab) between them; and by the triangle
    inequality it is at least the difference of their angles to any pivot. A thousandth is left for rounding.
    """
    stats = chunked.groupBy("block", "side", "chunk").agg(
        F.count("*").alias("n"), F.max("norm").alias("norm"), F.min("rank").alias("first"), F.max("rank").alias("last"),
        F.array(*[F.min(F.get("angles", k)) for k in range(pivots)]).alias("low"),
        F.array(*[F.max(F.get("angles", k)) for k in range(pivots)]).alias("high"))
    stats = materialize(stats, "chunks")

    def of(side, name):
        own = stats.filter(F.col("side") == side)
        return own.select("block", F.col("chunk").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "norm", "first", "last", "low", "high")])
    gaps = F.zip_with(F.zip_with("p_low", "i_high", lambda x, y: x - y), F.zip_with("i_low", "p_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    gap = F.coalesce(F.array_max(gaps), F.lit(0.0))
    most = F.col("p_norm") * F.col("i_norm")
    may = F.lit(True) if threshold <= 0 else (most >= threshold - 1e-6) & (
        gap <= F.acos(F.least(F.lit(1.0), F.lit(threshold) / F.greatest(most, F.lit(threshold)))) + 1e-3)
    if ordered and not same:
        may &= F.col("i_first") < F.col("p_last")
    both = of(0, "p").join(of(0, "i"), "block").filter(_in_cells("p") <= _in_cells("i")) if same else of(0, "p").join(of(1, "i"), "block")
    return both.select(
        "block", "p", "i", F.col("p_n").alias("probes"), F.col("i_n").alias("indexed"), may.alias("open"))


def tiled(pairs: DataFrame) -> DataFrame:
    """(block, pt, it, side, chunk, slot, n): the tiles of open pairs of chunks that each chunk is sent to, once a tile.

    A tile is up to TILE chunks of either side, neighbours in one cell first. `slot` is the place of an indexed chunk in its
    tile; of a probe chunk, the bits of the places it meets. Tiles grow only once there are TILES of them.
    """
    ways = max(1, min(TILE, math.isqrt(pairs.count() // TILES)))

    def places(name):
        order = Window.partitionBy("block").orderBy(_in_cells(name))
        return pairs.select("block", name).distinct().withColumn(f"{name}_at", F.row_number().over(order) - 1)
    placed = pairs.join(places("p"), ["block", "p"]).join(places("i"), ["block", "i"]).select(
        "*", F.expr(f"bigint(p_at div {ways})").alias("pt"), F.expr(f"bigint(i_at div {ways})").alias("it"), (F.col("i_at") % ways).alias("at"))
    tile = ["block", "pt", "it"]
    probes = placed.groupBy(*tile, F.lit(0).alias("side"), F.col("p").alias("chunk")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("slot"), F.max("probes").alias("n"))
    return probes.unionByName(placed.groupBy(*tile, F.lit(1).alias("side"), F.col("i").alias("chunk")).agg(
        F.max("at").cast("bigint").alias("slot"), F.max("indexed").alias("n")))


def _sides(probe: DataFrame, index: DataFrame, same: bool = False, whole: bool = False) -> DataFrame:
    """Rows of both sides, each once a block, or once a window with `whole`; blocks and bands go along where a row has several."""
    several = F.size("blocks") > 1
    key = F.xxhash64("window") if whole else F.explode("blocks")
    blocks = F.col("blocks") if whole else F.when(several, F.col("blocks"))
    bands = F.when(several & F.lit(not whole), F.col("bands"))

    def rows(df, side):
        return df.filter("vector is not null").select(
            key.alias("block"), F.lit(side).alias("side"), "window", "id", "rank", "vector", blocks.alias("blocks"), bands.alias("bands"))
    return rows(probe, 0) if same else rows(probe, 0).unionByName(rows(index, 1))


def chunked_sides(probe: DataFrame, index: DataFrame, largest: int, same: bool = False, whole: bool = False) -> tuple[DataFrame, int]:
    """(rows of both sides in chunks along the pivots, number of pivots), `largest` being the rows of the largest block.

    Pivots are fitted to about PIVOT_SAMPLE rows; they decide how much is skipped, never the result. There are no more
    cells than the largest block has chunks, so that chunks are full.
    """
    every = index.count()
    some = index.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(max(1, every // PIVOT_SAMPLE))) == 0).select("vector").limit(2 * PIVOT_SAMPLE)
    sample = np.array([r[0] for r in some.collect() if r[0] is not None], np.float64)
    pivots = fit_pivots(sample) if len(sample) else np.zeros((0, 0))
    if not len(pivots):
        pivots = np.zeros((1, sample.shape[1] if sample.ndim == 2 else 0))
    rows = _sides(probe, index, same, whole)
    placed = rows.withColumn("at", angles(pivots, math.ceil(largest / CHUNK_ROWS))(F.col("vector"))).select(
        *rows.columns, "at.cell", "at.shell", "at.norm", "at.angles")
    return _in_chunks(materialize(placed, "placed")), len(pivots)


def _dealt(sent: DataFrame, load: int) -> DataFrame:
    """Add `task` and `tasks` to the rows of `tiled`: a task for each tile, or, where there are very many, for TASK_ROWS rows."""
    tiles = sent.select("block", "pt", "it").distinct()
    count = tiles.count()
    if count > MOST_TILES:
        tasks = max(1, math.ceil(load / TASK_ROWS))
        return sent.withColumn("task", F.pmod(F.xxhash64("block", "pt", "it"), F.lit(tasks)).cast("int")).withColumn("tasks", F.lit(tasks))
    numbered = tiles.withColumn("task", F.row_number().over(Window.orderBy("block", "pt", "it")) - 1)
    return sent.join(numbered, ["block", "pt", "it"]).withColumn("tasks", F.lit(max(1, count)))


def similar_pairs(probe: DataFrame, index: DataFrame, threshold: float = GROUP_THRESHOLD, ordered: bool = True,
                  self_join: bool = False, ids: bool = True, most: int | None = None) -> DataFrame:
    """(window, later, later_rank, earlier, earlier_rank, score) for probe rows near index rows of their window.

    Both sides carry window, id, rank, vector and what `with_blocks` adds. With `ordered`, only index rows
    of a lower rank count. Vectors travel once per block, or once per tile of chunks; only pairs that pass leave a task. With
    `self_join`, or where both sides are one table, rows stand for both sides and two chunks meet once; blocks of a single row are
    left out, as they hold no pair. Where hashed blocks would compare more pairs than their windows hold, each pair of a window is
    compared once and counts if it shares a block: the same pairs.

    Without `ids` the pairs are told by their ranks alone. With `most` a task lets out only that many best pairs of each probe row
    (of the lowest rank on a tie, then of the greatest id), of which the caller takes the best ones.
    """
    same = ordered and most is None and (self_join or probe is index)

    def keys(df, side):
        return df.select(F.explode("blocks").alias("block"), F.size("blocks").alias("many"), F.lit(side).alias("side"))
    every = keys(probe, 0) if same else keys(probe, 0).unionByName(keys(index, 1))
    probes, indexed = F.count_if(F.col("side") == 0), F.count("*") if same else F.count_if(F.col("side") == 1)
    more = " and probes > 1" if same or self_join else ""

    def sized(rows):
        return materialize(rows.groupBy("block").agg(probes.alias("probes"), indexed.alias("indexed"), F.max("many").alias("many")).filter(
            "probes > 0 and indexed > 0" + more), "blocks")
    sums = [F.max(F.greatest("probes", "indexed")), F.sum(F.expr("probes + indexed")), F.sum(F.expr("probes * indexed")), F.max("many")]
    sizes, whole = sized(every), False
    largest, load, compared, many = sizes.agg(*sums).first()
    if (many or 0) > 1:
        windows = [df.select(F.xxhash64("window").alias("block"), F.lit(1).alias("many"), F.lit(side).alias("side"))
                   for side, df in enumerate([probe] if same else [probe, index])]
        windows = sized(windows[0] if same else windows[0].unionByName(windows[1]))
        of_windows = windows.agg(*sums).first()
        whole = compared > of_windows[2]
        if whole:
            sizes, (largest, load, *_) = windows, of_windows
    names = ["window", *(["id"] if ids or not ordered else []), "rank", "vector", "blocks", "bands"]
    if (largest or 0) > CHUNK_ROWS:
        rows, pivots = chunked_sides(probe, index, largest, same, whole)
        pairs = materialize(meeting_chunks(rows.join(sizes.select("block"), "block", "left_semi"), pivots, threshold, ordered, same).filter("open"), "chunk-pairs")
        sent = materialize(tiled(pairs), "tiles")
        load = pairs.agg(F.sum(F.expr("probes + indexed"))).first()[0]  # what is compared decides, so that few tiles are not one task
        dealt = materialize(_dealt(sent, load or 0), "dealt")
        tasks = (dealt.agg(F.max("tasks")).first()[0]) or 1
        bits, at = F.when(F.col("side") == 0, F.col("slot")), F.when(F.col("side") == 1, F.col("slot"))
        if same:  # a chunk is sent once to a tile that it is on both sides of
            dealt = dealt.groupBy("task", "block", "pt", "it", "chunk").agg(F.max(bits).alias("mask"), F.max(at).alias("slot"))
        else:
            dealt = dealt.select("task", "block", "pt", "it", "chunk", "side", bits.alias("mask"), at.alias("slot"))
        placed = rows.join(dealt, ["block", "chunk"] if same else ["block", "chunk", "side"]).withColumns(
            {"mask": F.coalesce("mask", F.lit(0).cast("bigint")), "slot": F.coalesce("slot", F.lit(-1).cast("bigint"))})
    else:
        tasks = max(1, math.ceil((load or 0) / TASK_ROWS))
        placed = _sides(probe, index, same, whole).join(sizes.select("block"), "block", "left_semi").select(
            "*", *[F.lit(0).cast("bigint").alias(c) for c in ("chunk", "pt", "it")], F.expr("bigint(1 - side)").alias("mask"),
            F.lit(0).cast("bigint").alias("slot") if same else F.expr("bigint(side - 1)").alias("slot"),
            F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int").alias("task"))
    tile = ["block", "pt", "it", "side", "chunk"]
    placed = placed.select("task", *tile, "mask", "slot", *names).repartitionById(tasks, F.col("task")).sortWithinPartitions(*tile).drop("task")
    kind = probe.schema["window"].dataType.simpleString()
    later, earlier = (f"{n} string, {n}_rank bigint" if ids else f"{n}_rank bigint" for n in ("later", "earlier"))
    return placed.mapInArrow(_score_tiles(threshold, ordered, same, ids, most, whole), f"window {kind}, {later}, {earlier}, score double")


def centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(group_id, vector): element-wise mean of member vectors, not brought back to unit length.

    A group is one row of sums in each map task, so that what is shuffled are vectors, not numbers, and large groups shrink first.
    """
    joined = members.join(vectors.select(F.col("id").alias("article_id"), F.col("embedding").cast("array<double>").alias("embedding")), "article_id")
    size = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    if size < 1:
        return joined.limit(0).select("group_id", F.col("embedding").alias("vector"))
    means = joined.groupBy("group_id").agg(
        F.max(F.size("embedding")).alias("size"), *[F.avg(F.get("embedding", k)).alias(f"m{k}") for k in range(size)])
    return means.filter("size > 0").select("group_id", F.slice(F.array(*[f"m{k}" for k in range(size)]), 1, F.col("size")).alias("vector"))
