"""Quality of whole texts by attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded from its own letters and words, a gated attention layer learns from the
labels of whole documents which passages tell most, and the attention-weighted mean of the encodings is scored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from issueloom.llm.batches import map_texts, slices, unused, word_hashes
from issueloom.session import materialize

PASSAGE_WORDS = 64
TRAIN_ROWS = 2000  # labelled documents that are learnt from at most
TRAIN_PASSAGES = 400_000  # passages of all of them together: rows that do not fit any more are not learnt from, texts are never cut
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 150, 0.02, 1e-4

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "|", "#$%&*@^~=+<>_/\\", " ",
            "\n\r", "?:;'\"()-[]{}`"]
_CLASS = np.full(256, len(_CLASSES), np.int64)  # the last class: all else, mostly bytes of other letters
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
LAGS = (1, 2, 3, 4)
FEATURES = len(_CLASSES) + 1 + len(LAGS) + 3


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, passages per text). A text without words is one passage of zeros."""
    count = len(offsets) - 1
    words, starts, rows = word_hashes(data, offsets)
    per_row = np.bincount(rows, minlength=count)
    passages = np.maximum(1, -(-per_row // PASSAGE_WORDS))
    first_passage = np.append(0, np.cumsum(passages))[:-1]
    out = np.zeros((int(passages.sum()), FEATURES), np.float32)
    if not len(words):
        return out, passages
    rank = np.arange(len(words)) - (np.cumsum(per_row) - per_row)[rows]
    owner = first_passage[rows] + rank // PASSAGE_WORDS
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    ids = owner[heads]
    sizes = np.diff(np.append(heads, len(words))).astype(np.float32)
    # bytes from a passage's first word to the next passage's or to the end of its own text
    stops = np.minimum(np.append(starts[heads[1:]], len(data)), offsets[rows[heads] + 1])
    lengths = stops - starts[heads]
    byte_owner = np.repeat(np.arange(len(heads)), lengths)
    at = np.arange(len(byte_owner)) + np.repeat(starts[heads] - (np.cumsum(lengths) - lengths), lengths)
    kinds = len(_CLASSES) + 1
    counts = np.bincount(byte_owner * kinds + _CLASS[data[at]], minlength=len(heads) * kinds).reshape(-1, kinds)
    out[ids, :kinds] = counts / lengths[:, None]
    for i, lag in enumerate(LAGS):
        same = np.zeros(len(words), np.int64)
        same[lag:] = (words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])
        out[ids, kinds + i] = np.add.reduceat(same, heads) / sizes
    out[ids, -3] = np.log(lengths / sizes)
    out[ids, -2] = sizes / PASSAGE_WORDS
    out[ids, -1] = np.add.reduceat(_CLASS[data[starts]] == 1, heads) / sizes
    return out, passages


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Encoder, gated attention and score, with its training by plain gradient steps."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"W": r.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
                  "V": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
                  "w": r.normal(0, GATE ** -0.5, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, passages: np.ndarray) -> dict:
        p, heads = self.p, np.append(0, np.cumsum(passages))[:-1]
        owner = np.repeat(np.arange(len(passages)), passages)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, heads)[owner])
        a /= np.add.reduceat(a, heads)[owner]
        z = np.add.reduceat(a[:, None] * h, heads)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "owner": owner, "heads": heads,
                "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict, target: np.ndarray) -> dict:
        p, owner, heads, a, h, t, s = self.p, f["owner"], f["heads"], f["a"], f["h"], f["t"], f["s"]
        off = (f["score"] - target) / len(target)
        dz = off[owner, None] * p["c"]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, heads)[owner])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de,
                "c": f["z"].T @ off, "d": np.array([off.sum()])}

    def fit(self, x: np.ndarray, passages: np.ndarray, target: np.ndarray) -> "AttentionModel":
        if not len(target):
            return self  # nothing to learn from: every score is 0.5
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            for k, g in self.gradients(self.forward(x, passages), target).items():
                g = g + DECAY * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, x: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return self.forward(x, passages)["score"]


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_bags(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES):
    """(features, passages, targets) of at most `rows` labelled documents that are not held out, each with its whole text.

    Which ones is decided by a hash of their ids; one whose text would bring the sum above `passages` passages is passed over.
    A document with several labels has their mean as its target, one with several rows its least text.
    """
    picked = (labels.filter(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg(F.avg("quality").alias("target")).join(docs.select("doc_id"), "doc_id", "left_semi")
              .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows))
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # bounded above
    chosen = chosen.groupBy("doc_id", "target").agg(F.min("text").alias("text")).select("doc_id", "text", "target")

    def work(batches):
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                x, counts = passage_features(data, offsets)
                bags = [x[b - n:b].ravel() for b, n in zip(np.cumsum(counts), counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(counts, pa.int64()),
                     pa.array(bags, pa.list_(pa.float32()))], ["doc_id", "target", "n", "bag"])

    bags = materialize(map_texts(chosen, work, "doc_id bigint, target double, n bigint, bag array<float>"), "training-bags")
    fits, total = [], 0
    for r in bags.select("doc_id", "n").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").collect():  # `rows` of them at most
        if total + r.n <= passages:
            fits.append(r.doc_id)
            total += r.n
    got = bags.filter(F.col("doc_id").isin(fits)).drop("n").toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=lambda i: got["doc_id"][i])
    found = [np.array(got["bag"][i]).reshape(-1, FEATURES) for i in order]
    return (np.concatenate(found) if found else np.zeros((0, FEATURES)), np.array([len(b) for b in found], np.int64),
            np.array([got["target"][i] for i in order], float))


def train(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    return AttentionModel().fit(*training_bags(docs, labels.select(F.col("doc_id").cast("bigint"), "quality")))


def score(docs: DataFrame, model: AttentionModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of each whole text; null and empty texts too. A column called `out` is replaced."""
    kept = [c for c in docs.columns if c != out]
    docs = docs.select(*kept)

    def work(batches):
        for batch in batches:
            values = [model.scores(*passage_features(data, offsets))
                      for _, _, data, offsets in slices(batch.column(kept.index(text)))]
            values = np.concatenate(values) if values else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*kept, out])

    return map_texts(docs, work, docs.withColumn(out, F.lit(None).cast("double")).schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Without a label to learn from all scores are 0.5."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` that the classifier does not reject."""
    out = unused("_quality", docs)
    return score(docs, train(docs, labels), out=out).filter(F.col(out) >= 0.5).select(docs.columns)
