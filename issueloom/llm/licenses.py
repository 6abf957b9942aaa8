"""License notices and texts inside documents, by patience alignment with templates.

Words found once in a stretch of the document and once in the template are anchors; the longest increasing run of anchors
is kept, and the gaps between neighbours are aligned in the same way. Coverage is the share of template words that the
alignment reaches.
"""

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from issueloom.llm.batches import map_texts, slices, word_hashes

COVERAGE = 0.75

# Names and wordings of public licenses.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["This work has been dedicated to the public domain under CC0 1.0 Universal."],
    "All-Rights-Reserved": ["All rights reserved."],
}

_SIGNS = np.ones(256, bool)  # words are runs of letters and digits of any script
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _SIGNS[_first:_last + 1] = False


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops, piles, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = piles[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[pile], piles[pile] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """(place in text, place in template) of aligned words, both increasing."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(text[a:b]).items() if n == 1}
        place = {text[i]: i for i in range(a, b) if text[i] in once}
        counts = Counter(template[c:d])
        anchors = [(place[template[j]], j) for j in range(c, d) if counts[template[j]] == 1 and template[j] in place]
        kept = [anchors[k] for k in increasing([x for x, _ in anchors])]
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        if kept:
            todo += [(x + 1, y, p + 1, q) for (x, p), (y, q) in zip(edges, edges[1:])]
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, list[str]]):
        self.names, self.words = [], []
        for name, variants in texts.items():
            for variant in variants:
                raw = np.frombuffer(variant.encode(), np.uint8)
                self.names.append(name)
                self.words.append(word_hashes(raw, np.array([0, len(raw)]), _SIGNS)[0].tolist())
        self.vocabulary = np.unique(np.array([w for words in self.words for w in words], np.uint64))
        self.holds = np.zeros((len(self.vocabulary), len(self.words)), np.int32)
        for t, words in enumerate(self.words):
            self.holds[np.searchsorted(self.vocabulary, np.unique(np.array(words, np.uint64))), t] = 1
        # a text that covers enough of a template can lack only so many of its distinct words
        self.least = np.array([len(set(w)) - (len(w) - need(len(w))) for w in self.words])


def need(words: int) -> int:
    """Template words that an alignment must reach."""
    return -(-int(round(100 * COVERAGE)) * words // 100)


def _regions(hits: np.ndarray, size: int, least: int):
    """Stretches of text words, each holding `least` or more hits within 2 * size words; neighbours are one stretch."""
    places = np.flatnonzero(hits)
    if len(places) < least:
        return
    dense = np.flatnonzero(places[least - 1:] - places[:len(places) - least + 1] < 2 * size)
    for run in np.split(dense, np.flatnonzero(np.diff(places[dense]) > size) + 1) if len(dense) else ():
        yield int(places[run[0]]), int(places[run[-1] + least - 1]) + 1


def find_in(words: list, template: list) -> list[tuple[int, int, int]]:
    """(start, stop, matched) of each stretch of `words` that covers the template, one after the other."""
    known, least, out = set(template), need(len(template)), []
    hits = np.array([w in known for w in words], bool)
    for low, high in _regions(hits, len(template), least):
        at = low
        while at < high:
            # a stretch may hold several notices: take each by itself, from the first place that can begin one
            stop = min(high, at + 2 * len(template))
            pairs = align(words[at:stop], template)
            if len(pairs) >= least:
                first, last = at + pairs[0][0], at + pairs[-1][0] + 1
                # a stray word before or behind the notice must not stretch it: prefer a stretch of the template's length
                for low_, high_ in ((first, first + len(template)), (max(at, last - len(template)), last)):
                    close = align(words[low_:high_], template)
                    if len(close) >= len(pairs) and close[-1][0] - close[0][0] < last - first - 1:
                        pairs, first, last = close, low_ + close[0][0], low_ + close[-1][0] + 1
                out.append((first, last, len(pairs)))
                at = last
            else:
                at = at + 1 + int(np.argmax(hits[at + 1:high])) if hits[at + 1:high].any() else high
    return out


def scan_batch(templates: Templates, data: np.ndarray, offsets: np.ndarray):
    """(row, template, first word, last word + 1, matched, first byte): the best of overlapping findings in each row."""
    hashes, starts, rows = word_hashes(data, offsets, _SIGNS)
    count = len(offsets) - 1
    at = np.minimum(np.searchsorted(templates.vocabulary, hashes), len(templates.vocabulary) - 1)
    hit = templates.vocabulary[at] == hashes
    present = np.zeros((count, len(templates.vocabulary)), np.int32)
    present[rows[hit], at[hit]] = 1
    likely = present @ templates.holds >= templates.least
    ends = np.searchsorted(rows, np.arange(count + 1))
    for row in np.flatnonzero(likely.any(axis=1)).tolist():
        words = hashes[ends[row]:ends[row + 1]].tolist()
        found = [(m, m / len(templates.words[t]), -a, b, t) for t in np.flatnonzero(likely[row]).tolist()
                 for a, b, m in find_in(words, templates.words[t])]
        taken: list[tuple[int, int]] = []
        for m, _, a, b, t in sorted(found, reverse=True):
            if all(b <= x or y <= -a for x, y in taken):
                taken.append((-a, b))
                yield row, t, -a, b, m, int(starts[ends[row] - a] - offsets[row])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, license, n_matched, n_template, first_word, last_word, first_byte): notices found in every row's text.

    One row for each stretch that covers 75 of 100 words of a template; of overlapping stretches the one with more words
    matched, then the higher coverage, stays. Words are runs of letters and digits, in lower case. Null and
    empty texts have none; repeated rows are reported each. Map-only.
    """
    table = Templates(TEMPLATES if templates is None else templates)
    names = ["doc_id", "license", "n_matched", "n_template", "first_word", "last_word", "first_byte"]

    def work(batches):
        for batch in batches:
            out = []
            for low, _, data, offsets in slices(batch.column(1)):
                out += [(low + row, table.names[t], m, len(table.words[t]), a, b - 1, byte)
                        for row, t, a, b, m, byte in scan_batch(table, data, offsets)]
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                 *[pa.array(c, pa.int64()) for c in cols[2:]]], names)

    return map_texts(docs.select(F.col("doc_id").cast("bigint"), text), work,
                     "doc_id bigint, license string, " + ", ".join(f"{n} bigint" for n in names[2:]))
