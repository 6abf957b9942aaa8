"""Words of texts as numbers, and the runs of words that occur more than once in their text."""

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """(ids, offsets, words) of the words `[^\\x20\\x09-\\x0D]+`: equal ids are equal words of one text.

    Words of text t are ids[offsets[t]:offsets[t + 1]]. Words of different texts never share an id, so whatever is found
    equal lies in one text.
    """
    numbers, ids, ends, words = count(), [], [0], []
    for text in texts:
        own = text.split()  # of bytes, split() parts at these six characters and no others
        ids.extend(map(defaultdict(numbers.__next__).__getitem__, own))
        ends.append(len(ids))
        words.append(own)
    return np.array(ids, np.int64), np.array(ends, np.int64), words


def _repeated(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places `at` (ascending) whose key is there twice or more, by key and place, with a number for each such key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    group = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])) if len(keys) else ordered
    keep = np.bincount(group)[group] > 1 if len(keys) else np.zeros(0, bool)
    return at[order][keep], group[keep]


def repeated_grams(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(m, at, group, group_of) for m = 1, 2, 4, ..: first words `at` of the grams of m words that occur twice or more.

    Places come by group and then in order; equal groups are equal grams; group_of has the group of every place of the
    text, -1 for a gram that occurs once. Each length is made of two halves of the one before, so nothing is hashed, and
    only what still repeats is looked at. Ends with the longest repeated gram.
    """
    n = len(ids)
    at, group = _repeated(ids, np.arange(n))
    m = 1
    while len(at):
        group_of = np.full(n, -1, np.int64)
        group_of[at] = group
        yield m, at, group, group_of
        first = np.sort(at)
        first = first[first + m < n]
        first = first[group_of[first + m] >= 0]
        at, group = _repeated(group_of[first] * (n + 1) + group_of[first + m], first)
        m *= 2
