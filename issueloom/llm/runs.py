"""Periodic runs of words: stretches that repeat with some period, found in one pass over the words of a text.

A pass keeps, for every open lag, where its stretch begins: each word that equals the word one lag before it makes the
match longer, and the first that does not ends it, and the run is given out at once. What makes this sparse is when a lag
opens. An earlier occurrence of the word at hand opens its lag only if the words that follow are known to repeat for a whole
period (grams of doubling length tell), and not if an open lag that divides it covers the same words. Then natural text
opens next to nothing, and text of one word opens one lag instead of one for every word.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from issueloom.llm.batches import SLICE_BYTES, map_texts
from issueloom.llm.grams import repeated_grams, word_ids

LEAST = 12  # words of a run
SMALL = 8  # lags below this are compared word by word

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _small_lags(ids: np.ndarray):
    """(word, lag) at the head of every match of a lag below SMALL that is long enough for a run."""
    for lag in range(1, SMALL):
        same = np.concatenate([[False], ids[lag:] == ids[:max(len(ids) - lag, 0)], [False]])
        heads, ends = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        heads = heads[ends - heads >= max(lag, LEAST - lag)]
        yield heads + lag, np.full(len(heads), lag)


def _large_lags(ids: np.ndarray, m: int, at: np.ndarray, group: np.ndarray, group_of: np.ndarray):
    """(word, lag) at the head of every match of a lag in m .. 2m - 1 that is a period long or more.

    Walks from each gram of m words back over its earlier occurrences. Those that the same word precedes are not the head
    of a match; neighbours that agree in it are left behind in one step, which keeps the walk short in periodic text.
    """
    before = np.where(at > 0, ids[at - 1], -1)
    place = np.arange(len(at))
    new_group = np.append(True, group[1:] != group[:-1])
    group_head = np.maximum.accumulate(np.where(new_group, place, 0))
    new_run = new_group | np.append(True, before[1:] != before[:-1])
    run_head = np.maximum.accumulate(np.where(new_run, place, 0))
    here, back = place, run_head - 1
    while len(here):
        near = (back >= group_head[here]) & (at[here] - at[np.maximum(back, 0)] < 2 * m)
        here, back = here[near], back[near]
        lag = at[here] - at[back]
        head = lag >= m
        word, lag = at[here][head], lag[head]
        # a period long: the last m words of the first period's copy must repeat as well
        tail = word + lag - m
        whole = tail < len(ids)
        word, lag, tail = word[whole], lag[whole], tail[whole]
        whole = (group_of[tail] >= 0) & (group_of[tail] == group_of[tail - lag])
        yield word[whole], lag[whole]
        back = back - 1
        inside = back >= group_head[here]
        here, back = here[inside], back[inside]
        back = np.where(before[back] == before[here], run_head[back] - 1, back)


def _openings(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a lag may open, and the lags, in order."""
    found = list(_small_lags(ids))
    for m, *grams in repeated_grams(ids):
        if m >= SMALL:
            found += _large_lags(ids, m, *grams)
    word, lag = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1))
    order = np.lexsort((lag, word))
    return word[order], lag[order]


def _pass(ids: list[int], openings: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, by start and period."""
    found, active, taken, i = [], {}, 0, 0
    while active or taken < len(openings):
        if not active:
            i = openings[taken][0]  # nothing is open: on to the next place where something may be
        word = ids[i] if i < len(ids) else None
        ended = [lag for lag in active if ids[i - lag] != word]
        for lag in ended:
            start = active[lag]
            # a smaller period of the same words would be open over all of them
            if i - start >= max(LEAST, 2 * lag) and all(p >= lag or s > start for p, s in active.items()):
                found.append((start, i - start, lag))
        for lag in ended:
            del active[lag]
        while taken < len(openings) and openings[taken][0] == i:
            lag = openings[taken][1]
            # under a lag that divides this one and began no later, both end at the same word
            if not any(lag % p == 0 and s <= i - lag for p, s in active.items()):
                active[lag] = i - lag
            taken += 1
        i += 1
    return sorted(found)


def text_runs(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[list[bytes]]]:
    """(runs, words) of each text."""
    ids, offsets, words = word_ids(texts)
    word, lag = _openings(ids)
    out = []
    for t in range(len(texts)):
        a, b = np.searchsorted(word, offsets[t:t + 2])
        if a == b:
            out.append([])
            continue
        own = ids[offsets[t]:offsets[t + 1]].tolist()
        out.append(_pass(own, list(zip((word[a:b] - offsets[t]).tolist(), lag[a:b].tolist()))))
    return out, words


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those of any run after its first period, joined by one space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed, collapsed_sha256) of every row; map-only.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch whose smallest period q fits in twice, of 12 words or more, that no
    neighbouring word extends. `runs` holds (start, length, period) by start and period; `collapsed` has each run's first period
    only. Null, empty and blank texts have no words, no runs and '' left; repeated rows are reported each.
    """
    def work(batches):
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                texts, size, high = [], 0, low
                while high < batch.num_rows and (not texts or size < SLICE_BYTES):
                    texts.append((batch.column(1)[high].as_py() or "").encode())
                    size += len(texts[-1])
                    high += 1
                runs, words = text_runs(texts)
                left = [collapsed(w, r) for w, r in zip(words, runs)]
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], ["start", "length", "period"])
                ends = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array([len(w) for w in words], pa.int64()),
                     pa.ListArray.from_arrays(ends, structs), pa.array([t.decode() for t in left], pa.string()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"])
                low = high

    return map_texts(docs.select(F.col("doc_id").cast("bigint"), F.col(text)), work,
                     f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string, collapsed_sha256 string")


def run_digest(found: DataFrame) -> DataFrame:
    """The rows of `find_runs` with their number of runs, their longest run and digests, without the texts.

    Of equally long runs the first counts, then the one of the smallest period. Without a run its four columns are null.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256", "n_words")
