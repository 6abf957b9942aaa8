"""Local hash vectors for article text."""

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from issueloom.functions.slices import text_slices
from issueloom.functions.text import or_empty
from issueloom.rules import HASHES_PER_TOKEN, TOKEN_PATTERN, VECTOR_SIZE

KNOWN_TOKENS = 100_000


def token_cells(token: str) -> list[int]:
    """The signed cells one token adds to: cell number, or its complement for minus one."""
    digest = hashlib.sha256(token.encode()).digest()
    return [digest[i] % VECTOR_SIZE if digest[i + HASHES_PER_TOKEN] > 127 else ~(digest[i] % VECTOR_SIZE)
            for i in range(HASHES_PER_TOKEN)]


def _sums(words: list[list[str]], code: dict[str, int], cells: array) -> np.ndarray:
    """Signed cells of the words of each text, added up. New words are given a number in `code` and their `cells`."""
    before = len(code)
    flat = np.fromiter((code.setdefault(w, len(code)) for row in words for w in row), dtype=np.int64)
    for w in islice(code, before, None):
        cells.extend(token_cells(w))
    owner = np.repeat(np.arange(len(words)) * VECTOR_SIZE, [len(row) for row in words])
    known = np.array(cells, dtype=np.int64).reshape(-1, HASHES_PER_TOKEN)
    sign, dim = np.where(known < 0, -1.0, 1.0), np.where(known < 0, ~known, known)
    total = np.zeros(len(words) * VECTOR_SIZE)
    for i in range(HASHES_PER_TOKEN):
        total += np.bincount(owner + dim[flat, i], weights=sign[flat, i], minlength=len(total))
    return total.reshape(len(words), VECTOR_SIZE)


@pandas_udf(ArrayType(DoubleType()))
def hash_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unit vectors of lower-case texts. A token is hashed once as long as KNOWN_TOKENS are enough to remember.

    A row needs nothing but itself, so this is a map over the scan: exploding the tokens would shuffle
    a text-sized table only to bring each row back together. Tokens and vectors are held of one slice at a time.
    """
    pattern = re.compile(TOKEN_PATTERN)
    code, cells = {}, array("q")
    for texts in text_slices(batches):
        if len(code) > KNOWN_TOKENS:
            code, cells = {}, array("q")
        matrix = _sums([pattern.findall(text) for text in texts], code, cells)
        norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        yield pd.Series(list(np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)))


def article_text():
    return F.lower(F.concat_ws("\n", *[or_empty(F.col(c)) for c in ("title", "summary", "content")]))


def ensure_embeddings(articles: DataFrame) -> DataFrame:
    """Add vectors where there are none; rows that have one never reach Python."""
    missing = F.col("embedding").isNull() | (F.size("embedding") == 0)
    done = articles.filter(~missing)
    fresh = articles.filter(missing).withColumn("embedding", hash_vector(article_text()))
    return done.unionByName(fresh)


def clusterable(articles: DataFrame) -> DataFrame:
    return articles.filter(~F.col("is_excluded") & (F.size("embedding") > 0))
