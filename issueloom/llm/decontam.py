"""Benchmark items inside documents: size-partitioned MinHash containment search, confirmed on full shingle sets.

Items are partitioned by the size of their shingle sets. Each partition has a sketch length of its own: the bottom hashes
of an item, one more than the shingles a containing document may lack at the largest size of the partition, so that
a document that contains the item shares at least one of them. No containing document is missed, however long it is.
Items go out in blocks of bounded size, each with one pass over the documents; nothing of the documents is shuffled.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from issueloom.llm.batches import map_texts, shingle_hashes, slices, unused, word_hashes
from issueloom.session import materialize

CONTAINMENT = 0.75
BLOCK_SHINGLES = 2_000_000  # shingles of the items sent out at a time: 32 MB
FILTER_BITS = 22


def item_shingles(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n, shingles): the distinct shingle hashes of each item in hash order; items without words are left out."""
    def work(batches):
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                words, _, rows = word_hashes(data, offsets)
                hashes, owner, _ = shingle_hashes(words, rows, high - low)
                ends = np.searchsorted(owner, np.arange(high - low + 1))
                sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array(sets, pa.list_(pa.int64()))], ["item_id", "n", "shingles"])

    return map_texts(items.select(F.col(key).cast("bigint"), text), work,
                     "item_id bigint, n int, shingles array<bigint>").filter("n > 0")


def sketch_length(size: int) -> int:
    """Bottom hashes that items of the size partition of `size` keep: no set with the containment can lack them all."""
    largest = 2 ** math.ceil(math.log2(size)) if size > 1 else 1
    return min(size, largest - math.ceil(CONTAINMENT * largest) + 1)


class ItemIndex:
    """Sketches and full sets of one block of items, as sorted arrays."""

    def __init__(self, rows):
        self.ids = pa.array([r["item_id"] for r in rows], pa.int64())  # an item is its place here: ids may be null or repeated
        self.sizes = np.array([r["n"] for r in rows], np.int64)
        sets = [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows]
        self.sketch = np.unique(np.concatenate([np.sort(s)[:sketch_length(len(s))] for s in sets]))
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.may = np.zeros(2**FILTER_BITS, bool)
        self.may[(self.sketch >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.least = int(np.ceil(CONTAINMENT * self.sizes.min()))

    def contained(self, hashes: np.ndarray, owner: np.ndarray):
        """(document, item, shared) of the pairs that reach the containment; `owner` is sorted."""
        near = np.flatnonzero(self.may[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sketch, hashes[near]), len(self.sketch) - 1)
        for doc in np.unique(owner[near[self.sketch[at] == hashes[near]]]):
            low, high = np.searchsorted(owner, [doc, doc + 1])
            own = np.unique(hashes[low:high])
            if len(own) < self.least:
                continue
            first, last = np.searchsorted(self.hashes, own), np.searchsorted(self.hashes, own, side="right")
            spans = last - first
            hit = np.repeat(first - np.append(0, np.cumsum(spans)[:-1]), spans) + np.arange(spans.sum())
            items, shared = np.unique(self.owner[hit], return_counts=True)
            for item, count in zip(items, shared):
                if 100 * count >= round(100 * CONTAINMENT) * self.sizes[item]:
                    yield int(doc), int(item), int(count)


def _search(docs: DataFrame, index) -> DataFrame:
    """`docs` (key, text) as (key, item_id, n_item, n_shared), a row for each item that a text contains."""
    def work(batches):
        for batch in batches:
            out = []
            for low, high, data, offsets in slices(batch.column(1)):
                words, _, rows = word_hashes(data, offsets)
                hashes, owner, _ = shingle_hashes(words, rows, high - low)
                out += [(low + d, i, c) for d, i, c in index.value.contained(hashes, owner)]
            rows, items = np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), index.value.ids.take(pa.array(items)),
                 pa.array(index.value.sizes[items]), pa.array([o[2] for o in out], pa.int64())],
                ["key", "item_id", "n_item", "n_shared"])

    kind = docs.schema[0].dataType.simpleString()
    return map_texts(docs, work, f"key {kind}, item_id bigint, n_item bigint, n_shared bigint")


def _contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`_search` for all items. Where they are several blocks, the pairs of each are written before the next is sent."""
    spark = docs.sparkSession
    listed = item_shingles(items)
    # only item counts and, block by block, item shingles reach the driver
    total = listed.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(1.25 * total / BLOCK_SHINGLES))
    if blocks > 1:
        listed = materialize(listed, "items")
    parts = []
    for block in range(blocks):
        rows = listed.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        index = spark.sparkContext.broadcast(ItemIndex(rows))
        parts.append(_search(docs, index))
        if blocks > 1:
            parts[-1] = materialize(parts[-1], "contained")
            index.unpersist()
    if not parts:
        kind = docs.schema[0].dataType.simpleString()
        return spark.createDataFrame([], f"key {kind}, item_id bigint, n_item bigint, n_shared bigint")
    return reduce(DataFrame.unionByName, parts)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): documents whose shingles hold at least 75 of 100 of an item's.

    Shingles are five words, A-Z in lower case; a text of fewer words is one shingle; texts without words are in
    no pair. Repeated rows of either table give repeated pairs, and null ids stay null. An empty table on either side gives
    no rows.
    """
    return _contained(docs.select(F.col("doc_id").cast("bigint").alias("key"), F.col(text).alias("text")), items).withColumnRenamed("key", "doc_id")


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the rows whose text contains an item. A row is judged by its text alone, whatever its id."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    found = _contained(docs.select(digest.alias("key"), F.col(text).alias("text")), items).select("key").distinct()
    mark = unused("_text", docs)
    hits = materialize(found, "contaminated").select(F.col("key").alias(mark))
    return docs.withColumn(mark, digest).join(hits, mark, "left_anti").select(docs.columns)
