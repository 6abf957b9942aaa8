"""Whole texts are worked on a slice at a time, whatever an Arrow batch holds."""

import tracemalloc

import numpy as np
import pandas as pd

from issueloom.functions import slices
from issueloom.operators.embedding import hash_vector, token_cells


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(slices, "SLICE_CHARS", 10)
    texts = pd.Series(["a" * n for n in (3, 0, 25, 4, 6, 1)] + [None])
    out = list(slices.text_slices(iter([texts, texts.iloc[:0], texts.iloc[:1]])))
    assert [len(t) for t in out] == [2, 1, 2, 2, 1]
    assert pd.concat(out).tolist() == [*texts, texts[0]]


def test_vectors_of_a_large_batch_hold_the_tokens_of_a_slice(monkeypatch):
    r = np.random.default_rng(5)
    texts = pd.Series([" ".join(f"w{i}" for i in r.integers(0, 500, 200)) for _ in range(2000)] + ["", "!"])
    whole = np.concatenate([np.stack(v.to_numpy()) for v in hash_vector.func(iter([texts]))])
    monkeypatch.setattr(slices, "SLICE_CHARS", 20_000)
    tracemalloc.start()
    parts, sizes = [], []
    for v in hash_vector.func(iter([texts])):
        parts.append(np.stack(v.to_numpy()).astype(np.float32))
        sizes.append(len(v))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.concatenate(parts) == whole.astype(np.float32)).all() and max(sizes) < 40
    assert peak < 12_000_000  # in one piece: 400,000 tokens, over 40 MB
    want = np.zeros(128)
    for w in texts[7].split():
        for c in token_cells(w):
            want[c if c >= 0 else ~c] += 1 if c >= 0 else -1
    assert np.allclose(whole[7], want / np.linalg.norm(want)) and not whole[-2:].any()
