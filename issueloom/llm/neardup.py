"""Near-duplicate documents: MinHash bands propose, odd sketches weed out, full shingle sets confirm.

Equal shingle sets are one node from the start. In each bucket of each band the nodes first meet the bucket's least
node only; what that links is merged, and pairs inside a bucket are looked at one by one only where a bucket still
holds several components. So a large group of near copies costs one comparison a node, and no link is given up.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from issueloom.llm.batches import map_texts, mix, shingle_hashes, slices, unused, word_hashes
from issueloom.llm.components import component_roots
from issueloom.session import materialize

BANDS, BAND_ROWS = 24, 3  # at 0.75, a pair shares no band with a probability of 2e-6
BINS, SKETCH_BITS = 1024, 2048  # of one odd sketch: error of the estimate at 0.75 about 0.021
PERCENT = 75
SLACK = 0.13  # an estimate this far (six errors) below the threshold settles a pair without its sets
CHUNK = 1024

_random = np.random.default_rng(75)
_TIMES = _random.integers(1, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(1, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64)

NODE = "node binary, n_shingles bigint"


def shingle_sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    count = len(offsets) - 1
    words, _, rows = word_hashes(data, offsets)
    hashes, owner, _ = shingle_hashes(words, rows, count)
    ends = np.searchsorted(owner, np.arange(count + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def node_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _band_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One key per set and band; `values` holds the sets one after the other, none of them empty."""
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for times, plus in zip(_TIMES[band], _PLUS[band]):
            key = mix(key + np.minimum.reduceat((values ^ plus) * times, starts))
        keys[:, band] = key
    return keys.view(np.int64)


def _odd_sketches(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sketches as 64-bit words, samples): the least hash of each bin flips one bit of its set's bitmap."""
    owner = np.zeros(len(values), np.int64)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner)
    place = owner * BINS + (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.append(True, place[1:] != place[:-1])  # sets are sorted, so the first of a bin is its least
    bit = owner[first] * SKETCH_BITS + (mix(values[first]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=len(starts) * SKETCH_BITS) & 1).astype(np.uint8).reshape(len(starts), -1)
    return np.packbits(odd, axis=1).view(np.int64), np.bincount(owner[first], minlength=len(starts))


def _mark(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, mark, node, n_shingles, bands, sketch, samples) per row; bands and sketch are null for a text without words."""
    def work(batches):
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                sets = shingle_sets_of(data, offsets)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                bands, sketches, samples = [None] * len(sets), [None] * len(sets), np.zeros(len(sets), np.int64)
                if len(full):
                    values = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    words, samples[full] = _odd_sketches(values, starts)
                    for i, b, w in zip(full, _band_keys(values, starts), words):
                        bands[i], sketches[i] = b, w
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array([node_key(s) for s in sets], pa.binary()),
                     pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                     pa.array(sketches, pa.list_(pa.int64())), pa.array(samples, pa.int32()),
                     batch.column(2).slice(low, high - low)],
                    ["doc_id", "node", "n_shingles", "bands", "sketch", "samples", "mark"])

    return map_texts(docs.select(F.col("doc_id").cast("bigint"), text, _mark(text)), work,
                     f"doc_id bigint, {NODE}, bands array<bigint>, sketch array<bigint>, samples int, mark binary")


def estimate_reaches(flips: Column, samples_a: Column, samples_b: Column) -> Column:
    """Whether two sketches that differ in `flips` bits may belong to linked sets."""
    part = 1 - 2 * flips / F.lit(float(SKETCH_BITS))
    apart = F.when(part > 0, -F.lit(SKETCH_BITS / 2) * F.log(part))  # estimated size of the symmetric difference
    shared = (samples_a + samples_b - apart) / 2
    return F.coalesce(shared >= (PERCENT / 100 - SLACK) * F.greatest(samples_a, samples_b), F.lit(False))


def _flips(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _sketch_filter(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule them out."""
    kept = nodes.select("node", "sketch", "samples")
    sides = [kept.select(*[F.col(c).alias(f"{c}_{side}") for c in kept.columns]) for side in "ab"]
    joined = pairs.join(sides[0], F.col("a") == F.col("node_a")).join(sides[1], F.col("b") == F.col("node_b"))
    return joined.filter(estimate_reaches(_flips("sketch_a", "sketch_b"), F.col("samples_a"), F.col("samples_b"))).select("a", "b")


def _confirm(batches):
    last_key, last_set = None, None
    for batch in batches:
        keep = []
        sides = [list(slices(batch.column(f"text_{s}"))) for s in "ab"]
        sets_b = [s for _, _, d, o in sides[1] for s in shingle_sets_of(d, o)]
        keys = batch.column("a").to_pylist()
        for low, high, data, offsets in sides[0]:
            for i in range(low, high):
                if keys[i] != last_key:  # rows come sorted by a
                    one = offsets[i - low:i - low + 2]
                    last_key, last_set = keys[i], shingle_sets_of(data[one[0]:one[1]], one - one[0])[0]
                shared = len(np.intersect1d(last_set, sets_b[i], assume_unique=True))
                keep.append(100 * shared >= PERCENT * (len(last_set) + len(sets_b[i]) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, text): one text for each of the nodes in `wanted`."""
    ids = nodes.select("node", "doc_id").join(wanted, "node", "left_semi")
    found = docs.select(F.col("doc_id").cast("bigint"), F.col(text).alias("text")).join(ids, "doc_id").select("node", "text")

    def check(batches):  # a doc_id may stand on several texts: only the node's own one counts
        for batch in batches:
            mine = [node_key(s) for _, _, d, o in slices(batch.column(1)) for s in shingle_sets_of(d, o)]
            same = [a == b for a, b in zip(mine, batch.column(0).to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_()))

    return map_texts(found, check, "node binary, text string").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Pairs (a, b) of nodes whose full shingle sets reach the threshold."""
    pairs = materialize(pairs, "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = materialize(_texts_of(wanted, nodes, docs, text), "near-texts")
    a, b = [texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")) for side in "ab"]
    return map_texts(pairs.join(b, "b").join(a, "a").sortWithinPartitions("a"), _confirm, "a binary, b binary")


def _shared_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join components, among the nodes of one part of a bucket.

    Sketches rule out most pairs, a pair that shares an earlier band is left to that one, and components that a link has
    joined are not compared again; so what leaves the task is at most one link for each node, however many pairs it holds.
    """
    left = np.flatnonzero(rows["side"].to_numpy() == 0)
    right = np.flatnonzero(rows["side"].to_numpy() == 1)
    inside = not len(right)
    right = left if inside else right
    out = []
    if len(left):
        nodes, samples = rows["node"].tolist(), rows["samples"].to_numpy()
        words = np.stack(rows["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
        bands = np.stack(rows["bands"].to_numpy()).astype(np.int64)
        earlier = int(np.flatnonzero(bands[0] == rows["band"].iloc[0])[0])
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        codes, root = np.unique(np.array([c.hex() for c in rows["comp"]]), return_inverse=True)
        for i in left.tolist():
            other = right[right > i] if inside else right
            other = other[root[other] != root[i]]
            if not len(other):
                continue
            flips = np.bitwise_count(words[other] ^ words[i]).sum(axis=1)
            part = np.maximum(1 - 2 * flips / SKETCH_BITS, 1e-9)
            shared = (samples[i] + samples[other] + SKETCH_BITS / 2 * np.log(part)) / 2
            near = shared >= (PERCENT / 100 - SLACK) * np.maximum(samples[i], samples[other])
            near &= ~(bands[other, :earlier] == bands[i, :earlier]).any(axis=1)
            for j in other[near][np.argsort(-shared[near], kind="stable")].tolist():
                if root[i] == root[j]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= PERCENT * (len(sets[i]) + len(sets[j]) - common):
                    out.append((nodes[i], nodes[j]))
                    root[root == root[j]] = root[i]
    return pd.DataFrame(out, columns=["a", "b"]).astype(object)


def _links_between(buckets: DataFrame, nodes: DataFrame, comps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links (a, b) inside the buckets that still hold several components, each bucket in parts of bounded size."""
    placed = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter(
        "lo <> hi and n > 2").select("band", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    # the bucket's least node has met all others
    members = materialize(placed.join(split, "band").filter("node <> leader").select("band", "chunks", "node", "comp"), "near-unsettled")

    def sets(batches):
        for batch in batches:
            found = [s.tobytes() for _, _, d, o in slices(batch.column(1)) for s in shingle_sets_of(d, o)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    full = materialize(map_texts(_texts_of(members.select("node").distinct(), nodes, docs, text), sets, "node binary, shingles binary")
                       .join(nodes.select("node", "bands", "sketch", "samples"), "node"), "near-sets")
    cut = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")))
    parts = cut.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select(
        "band", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"), "node", "comp")
    return parts.join(full, "node").groupBy("band", "i", "j").applyInPandas(_shared_links, "a binary, b binary")


def _labelled(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, mark, node, n_shingles, component_id) of every row; `mark` is a digest of the row's text."""
    signed = materialize(signatures(docs, text), "near-signatures")
    full = signed.filter("n_shingles > 0")
    least = full.groupBy("node").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    nodes = materialize(full.join(least, ["node", "doc_id"]).dropDuplicates(["node"]).drop("mark"), "near-nodes")

    exploded = nodes.select("node", "doc_id", F.explode("bands").alias("band"))
    lead = exploded.groupBy("band").agg(F.min(F.struct("doc_id", "node")).alias("l"), F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(exploded.join(lead.select("band", F.col("l.node").alias("leader")), "band").select("band", "node", "leader"),
                          "near-buckets")
    stars = buckets.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(confirmed(_sketch_filter(stars, nodes), nodes, docs, text), "near-links")
    comps = component_roots(links).select("node", F.col("root").alias("comp"))
    more = _links_between(buckets, nodes, comps, docs, text)
    roots = component_roots(links.unionByName(more))
    heads = roots.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(heads, "root").select("node", "component_id")
    final = nodes.select("node", "doc_id").join(named, "node", "left").select(
        "node", F.coalesce("component_id", "doc_id").alias("component_id"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return signed.select("doc_id", "mark", "node", "n_shingles").join(final, "node", "left").withColumn("component_id", component)


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`.

    Texts without words (null, empty, blank) are linked with nothing. Repeated rows and equal sets share a component.
    A row without a doc_id leads nothing: it gets the component of the documents with its very set, or none, and is kept
    only in the second case. Other columns are not looked at.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return _labelled(docs, text).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def first_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `docs`, one of each group of near duplicates: that of the least doc_id, and of its repeated rows one.

    Rows without a doc_id stay unless documents with one have their very set of shingles.
    """
    names, own, mark = docs.columns, unused("_id", docs), unused("_mark", docs)
    labelled = _labelled(docs, text)
    marked = docs.withColumn(own, F.col("doc_id").cast("bigint")).withColumn(mark, _mark(text))
    leads = labelled.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.min("mark").alias(mark))
    kept = marked.join(leads, [own, mark], "left_semi").dropDuplicates([own, mark]).select(names)
    loose = labelled.filter("doc_id is null and component_id is null").select(F.col("mark").alias(mark)).distinct()
    return kept.unionByName(marked.filter(F.col(own).isNull()).join(loose, mark, "left_semi").select(names))
