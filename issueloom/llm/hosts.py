"""Quality rules judged by host: failures counted by domain, rates shrunk by an empirical beta prior, verdicts joined back.

A single text says little about a rule; a host with many failing texts says much. Each rule has a beta prior of its own,
fitted to the failure counts of all hosts by the method of moments, so that a host of three texts is judged mostly by what
hosts are like, and a host of a million texts by its own.
"""

import pyarrow as pa
import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from issueloom.llm.batches import SLICE_BYTES, map_texts
from issueloom.llm.grams import repeated_grams, word_ids
from issueloom.session import materialize

WINDOW = 8  # words of a window, a power of two
LEAST_WORDS, REPEATED_SHARE = 20, 30
HOST_LIMIT = 0.5  # a host goes when more than this share of its texts is expected to fail a rule
SALTS = 16
MOST_STRENGTH, LEAST_STRENGTH = 1e6, 1e-3

_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"

#: Rules over the counts of a text, as SQL conditions. The first two are the base rules, which reject a text by itself.
BASE_RULES = {"few_words": f"n_words < {LEAST_WORDS}", "repeated_words": f"100 * n_repeat_words > {REPEATED_SHARE} * n_words"}
RULES = BASE_RULES | {"symbols": "10 * n_symbols > n_words", "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
                      "long_words": "word_chars > 50 * n_words"}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _counts(texts: list[bytes]) -> list[np.ndarray]:
    ids, offsets, _ = word_ids(texts)
    covered = np.zeros(len(ids) + 1, np.int64)
    for m, at, _, _ in repeated_grams(ids):
        if m == WINDOW:
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
            break
    inside = np.append(0, np.cumsum(np.cumsum(covered)[:-1] > 0))
    lines = [[line for line in t.split(b"\n") if line.strip(_BLANKS)] for t in texts]
    return [np.diff(offsets),
            # a code point has one byte that continues no other
            np.array([int(np.count_nonzero((np.frombuffer(t.translate(None, _BLANKS), np.uint8) & 0xC0) != 0x80)) for t in texts]),
            np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts]),
            np.array([len(own) for own in lines]),
            np.array([len(own) - len(set(own)) for own in lines]),
            inside[offsets[1:]] - inside[offsets[:-1]]]


def rule_counts(docs: DataFrame, host: str | Column = "source", text: str = "text") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row; map-only.

    Lines are those with a word; n_repeat_words counts the words inside windows of eight that are in the text twice or
    more. Null and empty texts count nothing; repeated rows are counted each.
    """
    def work(batches):
        for batch in batches:
            low = 0
            while low < batch.num_rows:  # some rows at a time: about SLICE_BYTES, one row at least
                texts, size, high = [], 0, low
                while high < batch.num_rows and (not texts or size < SLICE_BYTES):
                    texts.append((batch.column(2)[high].as_py() or "").encode())
                    size += len(texts[-1])
                    high += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                     *[pa.array(c, pa.int64()) for c in _counts(texts)]], ["doc_id", "host", *COUNTS])
                low = high

    host = F.col(host) if isinstance(host, str) else host
    return map_texts(docs.select(F.col("doc_id").cast("bigint"), host.cast("string").alias("host"), F.col(text)), work,
                     "doc_id bigint, host string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def host_rates(counts: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(host, rule, n, failed, rate): each host's shrunk failure rate by rule. Texts without a host are not counted.

    With p the share of failures over all texts and rho the share of the variance that lies between hosts (Kleinman's
    moments, size-weighted), the prior weighs 1 / rho - 1 texts of share p. A single host, or hosts that do not differ,
    get p itself.
    """
    named = counts.filter("host is not null and trim(host) <> ''")
    by_host = named.groupBy("host").agg(F.count("*").alias("n"), *[
        F.count_if(F.expr(sql)).alias(f"_{name}") for name, sql in rules.items()])
    long = by_host.select("host", "n", F.expr("stack({}, {}) as (rule, failed)".format(
        len(rules), ", ".join(f"'{name}', _{name}" for name in rules))))
    long = materialize(long, "host-failures")  # read twice
    sums = long.groupBy("rule").agg(F.sum("n").cast("double").alias("all_n"), F.sum("failed").cast("double").alias("all_failed"),
                                    F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.count("*").alias("hosts"),
                                    F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("ratios"))
    prior = sums.selectExpr(
        "rule", "all_failed / all_n as p", "all_n - squares / all_n as spread",
        "ratios - all_failed * all_failed / all_n as between", "hosts").selectExpr(
        "rule", "p", "case when spread > 0 and p > 0 and p < 1 "
        "then ((between - p * (1 - p) * (hosts - 1)) / spread) / (p * (1 - p)) else 0 end as rho").selectExpr(
        "rule", "p", f"case when rho > 0 then greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, 1 / rho - 1)) "
        f"else {MOST_STRENGTH} end as strength")
    return long.join(F.broadcast(prior), "rule").select(  # one row a rule
        "host", "rule", "n", "failed", F.expr("round((failed + strength * p) / (n + strength), 9)").alias("rate"))


def rejected_hosts(rates: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host) of those whose shrunk rate of any rule lies above `limit`."""
    return rates.filter(F.col("rate") > limit).select("host").distinct()


def judge(docs: DataFrame, host: str | Column = "source", text: str = "text", rules: dict[str, str] = RULES,
          limit: float = HOST_LIMIT) -> DataFrame:
    """The counts of every row with `base_failed`, `host_rejected` and `kept`, which is neither of the two.

    Texts without a host (null or blank) are judged by themselves alone, as are those of hosts that are not rejected.
    A host may hold any share of the rows: its counts are partial sums, and verdicts are joined on the host and one of
    `SALTS` parts of its texts, so that no task gets all of them.
    """
    counts = materialize(rule_counts(docs, host, text), "rule-counts")
    gone = rejected_hosts(host_rates(counts, rules), limit).select(
        "host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"), F.lit(True).alias("host_rejected"))
    part = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    base = F.expr(" or ".join(f"({sql})" for sql in BASE_RULES.values()))
    return (counts.withColumn("part", part).join(gone, ["host", "part"], "left").drop("part", "host")
            .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
            .withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))
