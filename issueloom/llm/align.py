"""Two tokenizers' tokens of one text, aligned: the smallest groups of tokens that cover the same bytes.

A text is cut into byte ranges. What one range says is a fragment: the tokens up to its first common end (open, as the group
may have begun before), the groups closed inside it, and the tokens after its last common end (open as well). Fragments are a
monoid: `compose` joins neighbours, is associative, and `Fragment()` is its neutral element. So the ranges of a very long text
are worked on as rows of their own and joined in a tree of small groups across tasks; other texts are one fragment.
"""

import os
import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from issueloom.llm.batches import SLICE_BYTES, map_texts
from issueloom.session import materialize

RANGE_BYTES = 1 << 16  # bytes of a fragment; texts of more are composed across tasks
FAN = 8  # neighbouring fragments joined in one group
FAST_CHARS = 100_000  # texts of more go to the slower of two equal encoders, whose splitter bears runs of blanks of any length

FRAGMENT = ("no bigint, n_a bigint, n_b bigint, n_groups bigint, cut boolean, a_head array<int>, b_head array<int>, body string, "
            "links array<bigint>, a_tail array<int>, b_tail array<int>")
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>"

_NONE = np.zeros(0, np.int32)


class Pair:
    """The two tokenizers: ids of a text by A (byte-level BPE, given space and text) and by B (pieces, which adds the space).

    `pattern` is the one that byte-level vocabularies are split by. With it the vocabulary file's tokens, ranked by id, give the
    same ids in a second library at a third of the time.
    """

    def __init__(self, byte_level: str, pieces: str, pattern: str):
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes, self.b_bytes = self._a_bytes(), self._b_bytes()
        if b"" in self.a_bytes or b"" in self.b_bytes:
            raise ValueError("a vocabulary has a token without bytes")
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.fast_a = tiktoken.Encoding("a", pat_str=pattern, special_tokens={}, mergeable_ranks={
            t: i for i, t in enumerate(self.a_bytes) if i not in special})
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.put = [f"{i}{end}" for end in ",|;" for i in range(most)]  # an id with what stands behind it
        self.most = most

    def _a_bytes(self) -> list[bytes]:
        # byte-level vocabularies write each byte as a visible character: itself, or the next code point from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        return [bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, _ in vocabulary]

    def _b_bytes(self) -> list[bytes]:
        def of(piece):
            byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
            return bytes([int(byte.group(1), 16)]) if byte else piece.replace("▁", " ").encode()
        return [of(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]

    def tokens(self, texts: list[str]):
        """(ids of A, ids of B) of each text; no ids where the bytes of either are not those of space and text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a, target = self.a_ids(" " + text), (" " + text).encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == target == b"".join(map(self.b_bytes.__getitem__, b))
            yield (np.array(a, np.int32), np.array(b, np.int32)) if same else (_NONE, _NONE)

    def a_ids(self, text: str) -> list[int]:
        if len(text) <= FAST_CHARS:
            return self.fast_a.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def group(self, a, b) -> str:
        return ",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";"


@lru_cache(maxsize=2)
def pair(byte_level: str, pieces: str, pattern: str) -> Pair:
    return Pair(byte_level, pieces, pattern)


def link(a, b):
    """One number for a pair of ids that end together."""
    return (np.int64(a) << 32 if np.isscalar(a) else a.astype(np.int64) << 32) | b


@dataclass
class Fragment:
    """`head`: tokens up to the first common end, or all if there is none (`cut` false). `body`: the groups closed since, each
    with ';' behind it, and `links` their pairs of last ids. `tail`: tokens after the last common end."""

    cut: bool = False
    a_head: np.ndarray = field(default_factory=lambda: _NONE)
    b_head: np.ndarray = field(default_factory=lambda: _NONE)
    body: str = ""
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    a_tail: np.ndarray = field(default_factory=lambda: _NONE)
    b_tail: np.ndarray = field(default_factory=lambda: _NONE)


def fragment(of: Pair, a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of the tokens that end inside one byte range."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(common):
        return Fragment(False, a_ids, b_ids)
    i, j = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
    a, b = a_ids[i[0] + 1:i[-1] + 1], b_ids[j[0] + 1:j[-1] + 1]
    # a token of A stands behind the tokens of B of all groups before its own; one of B also behind those of A of its own
    group_a, group_b = np.repeat(np.arange(len(i) - 1), np.diff(i)), np.repeat(np.arange(len(j) - 1), np.diff(j))
    line = np.empty(len(a) + len(b), np.int64)
    kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    kind_a[i[1:] - i[0] - 1], kind_b[j[1:] - j[0] - 1] = 1, 2
    line[np.arange(len(a)) + (j[group_a] - j[0])] = a + kind_a * of.most
    line[np.arange(len(b)) + (i[group_b + 1] - i[0])] = b + kind_b * of.most
    return Fragment(True, a_ids[:i[0] + 1], b_ids[:j[0] + 1], "".join(map(of.put.__getitem__, line.tolist())),
                    link(a_ids[i[1:]], b_ids[j[1:]]), a_ids[i[-1] + 1:], b_ids[j[-1] + 1:])


def compose(of: Pair, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative."""
    both = np.concatenate
    if not x.cut:
        return Fragment(y.cut, both([x.a_head, y.a_head]), both([x.b_head, y.b_head]), y.body, y.links, y.a_tail, y.b_tail)
    if not y.cut:
        return Fragment(True, x.a_head, x.b_head, x.body, x.links, both([x.a_tail, y.a_head]), both([x.b_tail, y.b_head]))
    closed = of.group(both([x.a_tail, y.a_head]).tolist(), both([x.b_tail, y.b_head]).tolist())
    links = both([x.links, link(y.a_head[-1:], y.b_head[-1:]), y.links])
    return Fragment(True, x.a_head, x.b_head, x.body + closed + y.body, links, y.a_tail, y.b_tail)


def finish(of: Pair, whole: Fragment) -> tuple[str, np.ndarray]:
    """(groups, links) of a whole text, which begins and ends with a group: nothing of it stays open."""
    if not whole.cut:
        return "", whole.links
    first = of.group(whole.a_head.tolist(), whole.b_head.tolist())
    return (first + whole.body)[:-1], np.concatenate([link(whole.a_head[-1:], whole.b_head[-1:]), whole.links])


def _ranges(of: Pair, a: np.ndarray, b: np.ndarray, size: int):
    """(range, tokens of A, tokens of B, fragment) of every byte range of a text, in order; one without tokens too."""
    a_ends, b_ends = np.cumsum(of.a_sizes[a]), np.cumsum(of.b_sizes[b])
    count = max(1, -(-int(a_ends[-1]) // size)) if len(a) else 1
    marks = np.arange(count + 1) * size
    i, j = np.searchsorted(a_ends, marks, side="right"), np.searchsorted(b_ends, marks, side="right")
    for k in range(count):
        own_a, own_b = slice(i[k], i[k + 1]), slice(j[k], j[k + 1])
        yield k, i[k + 1] - i[k], j[k + 1] - j[k], fragment(of, a[own_a], a_ends[own_a], b[own_b], b_ends[own_b])


def _texts(batch: pa.RecordBatch, column: int):
    """(first row, texts) over runs of rows of about SLICE_BYTES, one row at least."""
    low = 0
    while low < batch.num_rows:
        texts, size, high = [], 0, low
        while high < batch.num_rows and (not texts or size < SLICE_BYTES):
            texts.append(batch.column(column)[high].as_py() or "")
            size += len(texts[-1])
            high += 1
        yield low, texts
        low = high


def _whole(docs: DataFrame, text: str, files: tuple[str, str, str]) -> DataFrame:
    """Finished rows of texts of one range each."""
    def work(batches):
        of = pair(*files)
        for batch in batches:
            for low, texts in _texts(batch, 1):
                rows = []
                for a, b in of.tokens(texts):
                    for _, n_a, n_b, part in _ranges(of, a, b, 1 << 62):
                        groups, links = finish(of, part)
                        rows.append((n_a, n_b, len(links), groups, links))
                n_a, n_b, n, groups, links = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(texts)), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n)],
                     pa.array(groups, pa.string()), pa.array(links, pa.list_(pa.int64()))],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return map_texts(docs.select(F.col("doc_id").cast("bigint"), text), work, ALIGNED)


_ARROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("count", pa.int64()), ("no", pa.int64()), ("n_a", pa.int64()),
                    ("n_b", pa.int64()), ("n_groups", pa.int64()), ("cut", pa.bool_()), ("a_head", pa.list_(pa.int32())),
                    ("b_head", pa.list_(pa.int32())), ("body", pa.string()), ("links", pa.list_(pa.int64())),
                    ("a_tail", pa.list_(pa.int32())), ("b_tail", pa.list_(pa.int32()))])


def _fields(part: Fragment) -> dict:
    return {"n_groups": len(part.links), "cut": part.cut, "a_head": part.a_head, "b_head": part.b_head, "body": part.body,
            "links": part.links, "a_tail": part.a_tail, "b_tail": part.b_tail}


def _fragment_of(row: dict) -> Fragment:
    ids = {k: np.array(row[k], np.int32) for k in ("a_head", "b_head", "a_tail", "b_tail")}
    return Fragment(row["cut"], body=row["body"], links=np.array(row["links"], np.int64), **ids)


def _fragments(docs: DataFrame, text: str, files: tuple[str, str, str], size: int) -> DataFrame:
    """A row for every byte range of every text, `key` being one number a row of `docs`, `count` its number of ranges."""
    def work(batches):
        of = pair(*files)
        for batch in batches:
            for low, texts in _texts(batch, 2):
                for t, (a, b) in enumerate(of.tokens(texts)):
                    key, doc = batch.column(0)[low + t].as_py(), batch.column(1)[low + t].as_py()
                    parts = list(_ranges(of, a, b, size))
                    for no, n_a, n_b, part in parts:
                        row = {"key": key, "doc_id": doc, "count": len(parts), "no": no, "n_a": n_a, "n_b": n_b, **_fields(part)}
                        yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("bigint"), text)
    return map_texts(rows, work, f"key bigint, doc_id bigint, count bigint, {FRAGMENT}")


def _composed(parts: DataFrame, files: tuple[str, str, str]) -> DataFrame:
    """One row for each FAN neighbours."""
    def work(table: pa.Table) -> pa.Table:
        of, rows = pair(*files), sorted(table.to_pylist(), key=lambda r: r["no"])
        whole = reduce(lambda x, y: compose(of, x, y), map(_fragment_of, rows))
        first = rows[0]
        return pa.Table.from_pylist([{
            "key": first["key"], "doc_id": first["doc_id"], "count": -(-first["count"] // FAN), "no": first["no"] // FAN,
            "n_a": sum(r["n_a"] for r in rows), "n_b": sum(r["n_b"] for r in rows), **_fields(whole)}], schema=_ARROW)

    return parts.groupBy("key", F.expr(f"no div {FAN}").alias("at")).applyInArrow(
        work, f"key bigint, doc_id bigint, count bigint, {FRAGMENT}")


def _finished(parts: DataFrame, files: tuple[str, str, str]) -> DataFrame:
    def work(batches):
        of = pair(*files)
        for batch in batches:
            rows = batch.to_pylist()
            done = [finish(of, _fragment_of(r)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], pa.int64()) for c in ("doc_id", "n_a", "n_b")]
                + [pa.array([len(links) for _, links in done], pa.int64()), pa.array([g for g, _ in done], pa.string()),
                   pa.array([links for _, links in done], pa.list_(pa.int64()))],
                ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return map_texts(parts, work, ALIGNED)


def align(docs: DataFrame, byte_level: str, pieces: str, pattern: str, text: str = "text", size: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links) of every row.

    `groups` is `a1,a2|b1;a3|b2,b3`: decimal ids of A and B in order. `links` holds, for each group, the pair of ids that end
    with it (`link`): every common end has one of each. Null and empty texts, and texts that either tokenizer does not
    give back byte by byte, have no tokens: zeros, '' and []. Repeated rows are aligned each, null ids too.

    Texts up to `size` bytes are a map over the table. The fragments of longer ones are composed in rounds, FAN of them to a
    group, each round a written table of these texts only; a task holds FAN fragments at a time.
    """
    files, long = (byte_level, pieces, pattern), F.coalesce(F.octet_length(text), F.lit(0)) >= size
    parts = materialize(_fragments(docs.filter(long), text, files, size), "fragments")
    while (parts.agg(F.max("count")).first()[0] or 1) > 1:
        parts = materialize(_composed(parts.filter("count > 1"), files).unionByName(parts.filter("count = 1")), "fragments")
    return _whole(docs.filter(~long), text, files).unionByName(_finished(parts, files))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold a pair, and whether no other pair of its id of B has more.

    Of two tokens that end together one is a suffix of the other, so there are no more pairs than the tokens of both
    vocabularies have bytes (about 500,000 for two of these), however many texts there are.
    """
    counted = materialize(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counted.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, bound: int) -> DataFrame:
    """`aligned` with n_links, n_best and count_sum in place of `links`; `bound` is the largest number of pairs there can be."""
    counts = pair_counts(aligned).limit(bound + 1).toArrow().combine_chunks().sort_by("pair")
    if len(counts) > bound:
        raise ValueError(f"more than {bound} pairs of ids")
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(
        counts[c].to_numpy() for c in ("pair", "n", "best")))
    names = [c for c in aligned.columns if c != "links"]

    def work(batches):
        pairs, n, best = sent.value
        for batch in batches:
            links = batch.column("links")
            ends = links.offsets.to_numpy().astype(np.int64)
            flat = links.values.to_numpy()[ends[0]:ends[-1]]
            ends = ends - ends[0]
            at = np.searchsorted(pairs, flat)
            sums = [np.append(0, np.cumsum(x[at].astype(np.int64)))[ends] for x in (best, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(np.diff(s)) for s in (ends, *sums)],
                [*names, "n_links", "n_best", "count_sum"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name != "links")
    return map_texts(aligned, work, f"{kept}, n_links bigint, n_best bigint, count_sum bigint")


def alignment_digest(docs: DataFrame, byte_level: str, pieces: str, pattern: str, text: str = "text", size: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): the alignment of every row in figures.

    The groups themselves are digested as they are made; only links are kept until their pairs are counted.
    """
    of = pair(byte_level, pieces, pattern)
    bound = int(of.a_sizes.sum() + of.b_sizes.sum())
    found = align(docs, byte_level, pieces, pattern, text, size)
    sha = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return with_counts(materialize(found.withColumn("groups_sha256", sha).drop("groups"), "links"), bound)
