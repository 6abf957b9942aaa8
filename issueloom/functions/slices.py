"""Arrow batches of whole texts, worked on a slice at a time."""

from collections.abc import Iterator

import pandas as pd

SLICE_CHARS = 2_000_000  # characters a worker works on at a time; a single longer text is one slice


def text_slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Runs of rows of about SLICE_CHARS characters, in order: an Arrow batch may hold ten thousand whole texts."""
    for texts in batches:
        low = held = 0
        for row, text in enumerate(texts):
            size = len(text or "")
            if row > low and held + size > SLICE_CHARS:
                yield texts.iloc[low:row]
                low, held = row, 0
            held += size
        if low < len(texts):
            yield texts.iloc[low:]
