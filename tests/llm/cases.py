"""Small tables with all that an operator must bear, and plain Python statements of what comes out."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiou") + r.choice("bcdlmnrst") for _ in range(r.randint(1, 4))) for _ in range(n))


def tricky_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, signs of all kinds."""
    long = words(1, 6000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (5, long), (6, "One two"), (7, "one TWO"), (8, "x" * 3000),
            (9, "naïve café 東京 🙂 １２３ ​ \r\n don't we'll  end "), (None, "no id at all here"), (None, None),
            (10, words(2, 120)), (11, words(2, 120) + " tail of some more words here"), (-4, "minus")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def with_clashes(df):
    """The same rows with further columns called as results and helpers are."""
    for name in ("score", "shard", "slot", "size", "node", "kept", "token_ids", "spans", "did", "tkey", "_mark", "_id", "rank", "key"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def word_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text):
    w = word_list(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
