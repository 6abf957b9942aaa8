"""Arrow batches of texts as flat byte arrays, and shingle hashes of words.

A null text counts as an empty one everywhere in this package.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 512  # texts in one Arrow batch: long texts must not meet ten thousand at a time in one worker
SLICE_BYTES = 4_000_000  # bytes worked on at a time; a single longer text is one slice
SHINGLE_WORDS = 5


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, as rows here are whole texts. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(df: DataFrame, fn, schema: str) -> DataFrame:
    """`df.mapInArrow(fn, schema)` in batches of few rows."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def unused(name: str, df: DataFrame) -> str:
    """`name`, with underscores in front until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return every[first:offsets[-1]] if len(offsets) else every[:0], offsets - first


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over runs of rows of about SLICE_BYTES."""
    data, offsets = flat(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


_random = np.random.default_rng(20240131)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
for _upper in range(ord("A"), ord("Z") + 1):
    _BYTE[_upper] = _BYTE[_upper + 32]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, row) of every run of bytes that are not `blank`, A-Z taken as a-z.

    With the default, words are `[^\\x20\\x09-\\x0D]+`.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] |= inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    lengths = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(place.max()) + 1, _STEP))
    sums = np.add.reduceat(np.where(blank, np.uint64(0), _BYTE)[data[starts[0]:]] * powers[place], starts - starts[0])
    return mix(sums), starts, np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(words: np.ndarray, rows: np.ndarray, count: int, size: int = SHINGLE_WORDS
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every run of `size` words; a row of fewer words is one shingle of all of them."""
    per_row = np.bincount(rows, minlength=count)
    after = np.cumsum(per_row)
    room = after[rows] - np.arange(len(rows))  # words from this one to the end of its row
    width = np.minimum(per_row[rows], size)
    at = np.flatnonzero(room >= width)
    at = at[(width[at] == size) | (room[at] == per_row[rows[at]])]
    total = width[at].astype(np.uint64)
    for j in range(size):
        use = width[at] > j
        total[use] += words[at[use] + j] * _PLACE[j]
    return mix(total), rows[at], at
