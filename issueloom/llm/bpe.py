"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last of that prefix's encoding: the one whose
neighbour, the last token of the shorter prefix, stays beside it when both are merged alone. The table of these
last tokens encodes the piece, takes appended bytes without looking back, and after an edit is worked out again only
until it agrees with the old table over the length of the longest token.
"""

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from issueloom.llm.batches import map_texts

CACHE_PIECES = 400_000  # pieces a worker remembers; only speed depends on it
CACHED_CHARS = 64  # longer pieces are never remembered


class Vocabulary:
    """Ranks of byte strings, and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the neighbours of the lowest rank, leftmost first, until none are left."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stands_alone(self, token: int) -> bool:
        """True if merging the bytes of `token` gives `token` back."""
        if token not in self._alone:
            self._alone[token] = self.merge(self.bytes_of[token]) == [token]
        return self._alone[token]

    def may_follow(self, left: int, right: int) -> bool:
        """True if the bytes of both tokens, merged together, stay these two tokens."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._pairs[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one match of the pattern. A piece that is a token is that token."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else PrefixTable(self, piece).ids()


class PrefixTable:
    """The last token of every prefix of `data`."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, [-1]
        self._fill(len(data))

    def _fill(self, upto: int) -> None:
        ranks, data, last, v = self.vocabulary.ranks, self.data, self.last, self.vocabulary
        for end in range(len(last), upto + 1):
            for start in range(max(0, end - v.longest), end):
                token = ranks.get(data[start:end])
                if token is not None and (v.may_follow(last[start], token) if start else v.stands_alone(token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def append(self, more: bytes) -> "PrefixTable":
        """Go on from the stored table; nothing before the old end is looked at again but its last few bytes."""
        self.data += more
        self._fill(len(self.data))
        return self

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put `new` in place of data[start:stop]; return how many prefixes had to be worked out again."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start + 1]
        agreed = 0
        for end in range(start + 1, len(self.data) + 1):
            self._fill(end)
            beyond = end - shift > stop
            agreed = agreed + 1 if beyond and self.last[end] == old[end - shift] else 0
            # each later entry rests on the last `longest` ones and on bytes behind the edit only
            if agreed >= self.vocabulary.longest:
                self.last += old[end - shift + 1:]
                return end - start
        return len(self.data) - start

    def ids(self) -> tuple[int, ...]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[self.last[end]])
        return tuple(reversed(out))


class _Pieces(dict):
    """Encoded pieces, worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.vocabulary.encode_piece(piece.encode())
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Tokenizer:
    """Encodes and decodes whole texts; each match of the pattern is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.finder = regex.compile(pattern)
        self.pieces = _Pieces(self.vocabulary)
        self.decimal = {i: str(i) for i in self.vocabulary.bytes_of}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class EditableText:
    """A text with its encoding, kept right under appends and edits without encoding it all again."""

    def __init__(self, tokenizer: Tokenizer, text: str = ""):
        self.tokenizer, self.text = tokenizer, text
        self.pieces = [(m.start(), m.group()) for m in tokenizer.finder.finditer(text)]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> int:
        """Edit the text; return the number of pieces matched anew."""
        # a match looks at most three characters beyond its own start or one beyond its end
        keep = len(self.pieces)
        while keep and self.pieces[keep - 1][0] + max(3, len(self.pieces[keep - 1][1]) + 1) > start:
            keep -= 1
        begin = self.pieces[keep][0] if keep < len(self.pieces) else (
            self.pieces[-1][0] + len(self.pieces[-1][1]) if self.pieces else 0)
        shift = len(new) - (stop - start)
        later = {at + shift: i for i, (at, _) in enumerate(self.pieces) if at >= stop}
        self.text = self.text[:start] + new + self.text[stop:]
        fresh, tail = [], []
        for m in self.tokenizer.finder.finditer(self.text, begin):
            if m.start() in later and m.start() >= start + len(new):
                tail = [(at + shift, piece) for at, piece in self.pieces[later[m.start()]:]]
                break
            fresh.append((m.start(), m.group()))
        self.pieces = self.pieces[:keep] + fresh + tail
        return len(fresh)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.tokenizer.pieces[p] for _, p in self.pieces))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines `base64-token rank`."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(maxsize=2)
def _tokenizer(raw: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(read_ranks(raw), pattern)


def _shared(spark, ranks_file: str):
    """The vocabulary file, read by the driver and sent once to each executor. Its size is that of the vocabulary."""
    with open(ranks_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_file: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """`df` with an array column of token ids. A null or empty text has no tokens; other columns pass through.

    A column that is already called `out` is replaced. Map-only: nothing is shuffled, a lost executor costs its tasks.
    """
    raw = _shared(df.sparkSession, ranks_file)
    kept = [c for c in df.columns if c != out]

    def work(batches):
        tokenizer = _tokenizer(raw.value, pattern)
        for batch in batches:
            ids = [tokenizer.encode(t or "") for t in batch.column(kept.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*kept, out])

    return map_texts(df.select(*kept), work, df.select(*kept).withColumn(out, F.lit(None).cast("array<int>")).schema)


def decode(df: DataFrame, ranks_file: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`df` with the bytes that its ids stand for; null ids count as none. A column called `out` is replaced."""
    raw = _shared(df.sparkSession, ranks_file)
    kept = [c for c in df.columns if c != out]

    def work(batches):
        tokenizer = _tokenizer(raw.value, "")
        for batch in batches:
            data = [tokenizer.decode(i or ()) for i in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*kept, out])

    return map_texts(df.select(*kept), work, df.select(*kept).withColumn(out, F.lit(None).cast("binary")).schema)


def round_trip(df: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and the ids decoded again.

    One row out for each row in, repeated doc_ids and nulls included.
    """
    raw = _shared(df.sparkSession, ranks_file)

    def work(batches):
        tokenizer = _tokenizer(raw.value, pattern)
        decimal = tokenizer.decimal.__getitem__
        for batch in batches:
            counts, ids_sha, bytes_sha = [], [], []
            for text in batch.column(1):
                ids = tokenizer.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(tokenizer.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(df.select(F.col("doc_id").cast("bigint"), "text"), work,
                     "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
