"""Bytes inside long strings that repeat, by a sampled suffix array.

A string of LENGTH bytes is looked at through its first WINDOW bytes: the place of the least 8-byte hash there is its
anchor. Equal strings have their anchors in the same place, so sorting the suffixes at anchors only, about two in WINDOW,
finds every repeat. Strings with one anchor differ in how far they start before it; they are taken in blocks of
BLOCK starts, whose strings all hold one common core.

1. Sampled suffixes, as their leading bytes and digests of the core and of all that the block's strings cover, are
   range-partitioned by sampled splitters and sorted; equal ones are neighbours.
2. Where all surroundings are equal too, the whole block is a repeat: this settles copies, however many.
3. The rest, one of each kind, is fetched with its bytes, range-partitioned by leading bytes and sorted locally by
   multikey quicksort; strings in one run of equal cores are compared start by start.
4. Groups of more than HELD kinds are not gathered: each of their strings becomes its digest, and digests are counted.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from issueloom.llm.batches import map_texts, mix, slices
from issueloom.session import materialize

LENGTH, WINDOW, BLOCK, GRAM = 400, 200, 100, 8
HELD = 4096  # rows of equal cores that a task compares at a time, about 2.4 MB of bytes; strings of larger groups are counted by digest


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the eight bytes that start at each place; the last places have none."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    word = np.zeros(len(data) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        word |= data[j:len(data) - GRAM + 1 + j].astype(np.uint64) << np.uint64(8 * (GRAM - 1 - j))
    return word


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of values[i:i + width] for each i with a full window."""
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


_HIGH = np.uint64(0xFFFFFFFF00000000)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(row, place, first, last, leading words): the anchors of all strings of LENGTH bytes that lie within one text.

    The strings of an anchor start at first..last; the anchor is the leftmost least hash of their first WINDOW places.
    """
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(offsets[row + 1] - np.arange(len(data)) >= LENGTH) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, starts, starts, np.zeros(0, np.uint64)
    words = _gram_hashes(data)
    keyed = (mix(words) & _HIGH) | np.arange(len(words), dtype=np.uint64)  # 32 bits of hash, then leftmost
    place = (_window_minima(keyed, WINDOW)[starts] & ~_HIGH).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (np.diff(row[starts]) != 0)))
    last = np.append(first[1:], len(starts)) - 1
    return row[starts[first]], place[first], starts[first], starts[last], words


NARROW = ("did bigint, tkey bigint, lead bigint, core bigint, hull bigint, spot bigint, "
          "more array<struct<did: bigint, tkey: bigint, spot: bigint>>")
_CORE = LENGTH - BLOCK + 1


def _sampled_suffixes(batches):
    """One row for each anchor and block of starts. `spot` packs the anchor's place, its least and its most start before it.

    Equal ones of a batch, as in a text that repeats itself, are one row with `more` places.
    """
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for low, high, data, offsets in slices(batch.column(2)):
            row, place, first, last, words = anchors(data, offsets)
            near, far = place - last, place - first
            parts = []
            for block in range(WINDOW // BLOCK):
                a, b = np.maximum(near, block * BLOCK), np.minimum(far, block * BLOCK + BLOCK - 1)
                has = np.flatnonzero(a <= b)
                parts.append((row[has], place[has], a[has], b[has], place[has] - block * BLOCK))
            row, place, a, b, core = (np.concatenate(x) for x in zip(*parts))
            raw = data.tobytes()
            cores = [digest(raw[s:s + _CORE]) for s in core.tolist()]
            hulls = [digest(raw[s:e]) for s, e in zip((place - b).tolist(), (place - a + LENGTH).tolist())]
            hulls = np.array(hulls, np.uint64) ^ mix((a * WINDOW + b).astype(np.uint64))
            cores = np.array(cores, np.uint64)
            spot = ((place - offsets[row]) << 16) | (a << 8) | b
            lead = (words[core] ^ np.uint64(1 << 63)).view(np.int64) if len(core) else core
            kind, count = np.unique(cores * np.uint64(3) ^ mix(hulls), return_inverse=True, return_counts=True)[1:]
            order = np.argsort(kind, kind="stable")
            heads = np.append(0, np.cumsum(count))[:len(count)]
            first, rest = order[heads], np.delete(order, heads)
            at, others = pa.array(low + row[first]), pa.array(low + row[rest])
            more = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(count - 1)).astype(np.int32)), pa.StructArray.from_arrays(
                    [batch.column(0).take(others), batch.column(1).take(others), pa.array(spot[rest])], ["did", "tkey", "spot"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(lead[first]), pa.array(cores[first].view(np.int64)),
                 pa.array(hulls[first].view(np.int64)), pa.array(spot[first]), more],
                ["did", "tkey", "lead", "core", "hull", "spot", "more"])


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of `words` (big-endian 8-byte characters of strings) by multikey quicksort."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        part = order[low:high]
        letters = words[part, depth]
        pivot = np.sort(letters[[0, len(part) // 2, -1]])[1]
        less, same = letters < pivot, letters == pivot
        order[low:high] = np.concatenate([part[less], part[same], part[~less & ~same]])
        a, b = low + int(less.sum()), low + int(less.sum() + same.sum())
        todo += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _core_runs(cores: list[bytes]) -> list[np.ndarray]:
    """Groups of equal cores: neighbours in the sorted bucket that agree in all characters."""
    padded = -(-_CORE // 8) * 8
    words = np.frombuffer(b"".join(c.ljust(padded, b"\0") for c in cores), ">u8").astype(np.uint64).reshape(len(cores), -1)
    order = multikey_order(words)
    split = np.flatnonzero((words[order[1:]] != words[order[:-1]]).any(axis=1)) + 1
    return np.split(order, split)


def _compare_bucket(hulls: list[bytes], near: list[int], far: list[int]):
    """(member, least back, most back): strings that start so far before the anchors of a bucket and occur twice in it.

    Members share their leading bytes and the digest of their core; `back` counts bytes from a string's start to its anchor.
    """
    base = near[0] // BLOCK * BLOCK
    for run in _core_runs([h[f - base:f - base + _CORE] for h, f in zip(hulls, far)]):
        members = run.tolist()
        if len(members) < 2:
            continue
        backs: dict[int, list[int]] = {}
        for back in range(min(near[i] for i in members), max(far[i] for i in members) + 1):
            seen: dict[bytes, int] = {}
            twice = set()
            for i in members:
                if near[i] <= back <= far[i]:
                    at = far[i] - back
                    other = seen.setdefault(hulls[i][at:at + LENGTH], i)
                    if other != i:
                        twice.update((other, i))
            for i in twice:
                backs.setdefault(i, []).append(back)
        for i, found in backs.items():
            low = found[0]
            for one, following in zip(found, [*found[1:], None]):
                if following != one + 1:
                    yield i, low, one
                    low = following


def _buckets(batches):
    """(did, tkey, start, stop) of repeats, from the sorted rows of a partition: one run of equal (lead, core) at a time."""
    names = ["did", "tkey", "lead", "core", "spot", "bytes"]
    held: list[tuple] = []

    def compare(rows):
        spots = [r[4] for r in rows]
        for i, low, high in _compare_bucket([r[5] for r in rows], [s >> 8 & 255 for s in spots], [s & 255 for s in spots]):
            place = spots[i] >> 16
            yield rows[i][0], rows[i][1], place - high, place - low + LENGTH

    def packed(out):
        columns = list(zip(*out)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["did", "tkey", "start", "stop"])

    for batch in batches:
        out = []
        for row in zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in names)):
            if held and held[0][2:4] != row[2:4]:
                if len(held) > 1:
                    out += compare(held)
                held = []
            held.append(row)
        yield packed(out)
    yield packed(list(compare(held)) if len(held) > 1 else [])


def _fetch(batches):
    """One row for each listed suffix, with the bytes that its strings cover."""
    names = ["did", "tkey", "lead", "core", "spot", "bytes"]
    for batch in batches:
        out = {name: [] for name in names}
        for did, tkey, text, spots in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            for s in spots:
                place, near, far = s["spot"] >> 16, s["spot"] >> 8 & 255, s["spot"] & 255
                for name, value in zip(names, (did, tkey, s["lead"], s["core"], s["spot"], raw[place - far:place - near + LENGTH])):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.binary() if n == "bytes" else pa.int64()) for n in names], names)


def _digests(batches):
    """(did, tkey, start, string): each start of the listed suffixes, with the digest of its LENGTH bytes."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for did, tkey, text, spots in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            for s in spots:
                place, near, far = s["spot"] >> 16, s["spot"] >> 8 & 255, s["spot"] & 255
                starts = list(range(place - far, place - near + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([did] * len(starts), pa.int64()), pa.array([tkey] * len(starts), pa.int64()), pa.array(starts, pa.int64()),
                     pa.array([digest(raw[x:x + LENGTH]) for x in starts], pa.binary())], ["did", "tkey", "start", "string"])


def _cut(batches):
    for batch in batches:
        size, gone, runs, kept = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            raw = (text.as_py() or "").encode()
            merged: list[list[int]] = []
            for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            left = hashlib.sha256()
            at = 0
            for start, stop in merged:
                left.update(raw[at:start])
                at = stop
            left.update(raw[at:])
            size.append(len(raw))
            gone.append(sum(b - a for a, b in merged))
            runs.append(len(merged))
            kept.append(left.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (size, gone, runs)], pa.array(kept, pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """A key for every distinct row: rows of one key are equal in doc_id and, up to a 64-bit digest, in text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        F.coalesce("doc_id", F.lit(0)).alias("did"), F.xxhash64("text", F.col("doc_id").isNull()).alias("tkey"), "doc_id", "text")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(did, tkey, start, stop): byte ranges of the keyed rows that strings with another occurrence cover; they may overlap."""
    keyed = _keyed(docs, text)
    sampled = map_texts(keyed.select("did", "tkey", "text"), _sampled_suffixes, NARROW)
    sorted_ = sampled.repartitionByRange("lead", "core")
    same = Window.partitionBy("lead", "core", "hull")
    held = F.size("more") + 1
    counted = sorted_.withColumn("copies", F.sum(held).over(same)).withColumn(
        "turn", F.row_number().over(same.orderBy("did", "tkey", "spot"))).withColumn(
        "all", F.sum(held).over(Window.partitionBy("lead", "core")))
    repeats = materialize(counted.filter("all > 1"), "suffix-repeats")
    place, near, far = F.expr("spot >> 16"), F.expr("(spot >> 8) & 255"), F.expr("spot & 255")
    settled = repeats.filter("copies > 1").select(F.explode(F.concat(F.array(F.struct("did", "tkey", "spot")), "more")).alias("m")).select(
        "m.*").select("did", "tkey", (place - far).alias("start"), (place - near + LENGTH).alias("stop"))
    open_ = repeats.filter("all > copies and turn = 1").select("did", "tkey", "lead", "core", "spot")
    held_rows, counted_rows = _by_size(open_)
    fetched = map_texts(_texts_of(keyed, held_rows), _fetch, "did bigint, tkey bigint, lead bigint, core bigint, spot bigint, bytes binary")
    fetched = materialize(fetched, "suffix-bytes")
    compared = fetched.repartitionByRange("lead", "core").sortWithinPartitions("lead", "core").mapInArrow(
        _buckets, "did bigint, tkey bigint, start bigint, stop bigint")
    return settled.unionByName(compared).unionByName(_counted_spans(keyed, counted_rows))


def _by_size(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open rows of groups of (lead, core) that one task may hold, and those of larger groups."""
    open_ = materialize(open_, "suffix-open")
    large = open_.groupBy("lead", "core").agg(F.count("*").alias("n")).filter(F.col("n") > HELD).select("lead", "core")
    return open_.join(large, ["lead", "core"], "left_anti"), open_.join(large, ["lead", "core"], "left_semi")


def _texts_of(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    listed = rows.groupBy("did", "tkey").agg(F.collect_list(F.struct("lead", "core", "spot")).alias("spots"))
    return keyed.join(listed, ["did", "tkey"]).select("did", "tkey", "text", "spots")


def _counted_spans(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """(did, tkey, start, stop) of the strings of `rows` that occur twice, by partial counts of their digests; no group is gathered."""
    strings = materialize(map_texts(_texts_of(keyed, rows), _digests, "did bigint, tkey bigint, start bigint, string binary"), "suffix-strings")
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    return strings.join(twice, "string", "left_semi").select("did", "tkey", "start", (F.col("start") + LENGTH).alias("stop"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row: bytes under strings of LENGTH that start elsewhere too.

    Null texts count as empty; texts shorter than LENGTH lose nothing; matches never cross rows; repeated rows are each
    other's repeats. Other columns are not looked at.
    """
    spans = repeated_spans(docs, text).distinct().groupBy("did", "tkey").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = _keyed(docs, text).join(spans, ["did", "tkey"], "left").select("doc_id", "text", "spans")
    return map_texts(joined, _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
