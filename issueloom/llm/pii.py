"""Personal data in plain and in disguised spelling, as spans of the text as it stands.

Plain identifiers are found in the text itself. Then small transducers rewrite disguises (look-alike characters,
digits spelled as words, "at" and "dot" in place of signs) and keep, for every character they write, the source
characters it stands for. Identifiers found in the rewritten text are mapped back through that table.
"""

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from issueloom.llm.batches import map_texts

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. A look-behind stands where a match from inside a run could only repeat the failure from its head,
# so that long runs are read once; it changes no match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_DIGIT = re.compile(r"[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_SIGNS = {"at": "@", "dot": ".", "point": ".", "@": "@", ".": "."}
# fixed look-alikes: Cyrillic and Greek letters shaped like Latin ones, and signs of other scripts
_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ο": "o", "ν": "v", "ι": "i",
    "․": ".", "。": ".", "｡": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-",
    "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_DIGIT_WORD = "(?:%s)" % "|".join(_SPELLED)
_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\s-]+)?{_DIGIT_WORD}(?:[\s,-]+(?:(?:dot|point)[\s-]+)?{_DIGIT_WORD}){{2,}}(?![A-Za-z])", re.I)
_RUN_PART = re.compile(rf"plus|dot|point|{_DIGIT_WORD}", re.I)
# blanks are never given back: long runs of them beside a bracket or a word are read once
_ANY_DOT = r"(?:\s*+[\[({<])?+\s*+dot\s*+(?:[\])}>]\s*+)?"
_WORD_AT = re.compile(rf"(?<=[A-Za-z0-9])\s+(at)\s+(?=[A-Za-z0-9-]+?(?:{_ANY_DOT}[A-Za-z0-9-]+?)+(?![A-Za-z0-9]))", re.I)
_BRACKETED = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*+(at|dot|@|\.)\s*+[\])}>]\s*+", re.I)
_WORD_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+(dot)\s+(?=[A-Za-z0-9])", re.I)


def _look_alikes() -> dict[str, str]:
    """Every character that reads as an ASCII one (or as nothing), with that character."""
    out = dict(_ALIKE)
    for c in map(chr, range(0x80, 0x20000)):
        plain = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Nd":
            plain = str(unicodedata.decimal(c))
        if len(plain) == 1 and " " < plain < "\x7f":
            out.setdefault(c, plain)
    return out


_FOLD = _look_alikes()
_FOLDED = re.compile("[%s]" % "".join(map(re.escape, _FOLD)))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers as they stand, leftmost and not overlapping per kind, failures dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


class Mapped:
    """Text rewritten from `source`, another `Mapped` (or none: the text itself), with where each character comes from.

    Only what changes length is kept: parts in place of matches, in order, and how the text goes on behind each. A character
    is found by bisection, so memory follows the number of disguises and not the length of the text.
    """

    def __init__(self, text: str, source: "Mapped | None" = None):
        self.text, self.origin = text, source
        # of each part: place and length here, range in the source that it stands for, where the source goes on behind it
        self.at, self.size, self.low, self.high, self.after = (array("q") for _ in range(5))

    def _part(self, at: int, size: int, low: int, high: int, after: int) -> None:
        for column, value in zip((self.at, self.size, self.low, self.high, self.after), (at, size, low, high, after)):
            column.append(value)

    def rewrite(self, pattern: re.Pattern, new) -> "Mapped":
        """Put for each match the parts `new(match)`: (string, start, stop), each standing for text[start:stop]."""
        done, text, at, here = Mapped("", self), [], 0, 0
        for m in pattern.finditer(self.text):
            text.append(self.text[at:m.start()])
            here += m.start() - at
            at = m.end()
            parts = list(new(m))
            if len(parts) == 1 and len(parts[0][0]) == 1 == m.end() - m.start():  # one character for another moves nothing
                text.append(parts[0][0])
                here += 1
                continue
            for put, low, high in parts or [("", m.start(), m.end())]:
                done._part(here, len(put), low, high, m.end())
                text.append(put)
                here += len(put)
        if not at:
            return self
        text.append(self.text[at:])
        done.text = "".join(text)
        return done

    def _place(self, i: int) -> tuple[int, int]:
        """The range of the source that character i stands for."""
        k = bisect_right(self.at, i) - 1
        if k < 0:
            return i, i + 1
        behind = i - self.at[k] - self.size[k]
        return (self.low[k], self.high[k]) if behind < 0 else (self.after[k] + behind, self.after[k] + behind + 1)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The range of the first text that [start, end) stands for."""
        if self.origin is None:
            return start, end
        return self.origin.source(self._place(start)[0], self._place(end - 1)[1])


def _digits_back(mapped: Mapped) -> Mapped:
    """Three or more digits spelled one after the other become digits; "dot" between and "plus" before them, signs."""
    def parts(run):
        for m in _RUN_PART.finditer(mapped.text, *run.span()):
            word = m.group().lower()
            yield _SPELLED.get(word) or ("+" if word == "plus" else "."), *m.span()
    return mapped.rewrite(_RUN, parts)


def _signs_back(mapped: Mapped) -> Mapped:
    """"At" and "dot" become signs: in brackets anywhere, as bare words only where a disguised dot follows."""
    def sign(m):
        return [(_SIGNS[m.group(1).lower()], *m.span(1))]
    return mapped.rewrite(_WORD_AT, sign).rewrite(_BRACKETED, sign).rewrite(_WORD_DOT, sign)


def _may_be_disguised(text: str) -> bool:
    """False only if no transducer would change the text; plain substring tests come first, as they are fast."""
    if not text.isascii() and not _FOLD.keys().isdisjoint(set(text)):
        return True
    low = text.lower()
    if "dot" in low and _WORD_DOT.search(text):
        return True
    if any(c in text for c in "[({<") and _BRACKETED.search(text):
        return True
    spelled = any(w in low for w in _SPELLED if w not in ("one", "oh")) or any(
        a + between in low for a in ("one", "oh") for between in (" one", " oh", "-o", ",", " dot", " point", "  ", "\n", "\t"))
    return spelled and bool(_RUN.search(text))


def disguised_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers that appear once disguises are undone, in source characters."""
    if not _may_be_disguised(text):
        return []
    folded = Mapped(text).rewrite(_FOLDED, lambda m: [(_FOLD[m.group()], *m.span())])
    spelled = _digits_back(folded)
    found = set()
    for mapped in {m.text: m for m in (folded, spelled, _signs_back(folded), _signs_back(spelled))}.values():
        if mapped.text != text:
            found.update((kind, *mapped.source(a, b)) for kind, a, b in plain_spans(mapped.text))
    return sorted(found)


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, plain and disguised spans), by kind as listed, then by start.

    A disguised span that overlaps one of its kind that was found before it is left out: plain ones always stay.
    """
    plain = plain_spans(text)
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    taken = {kind: sorted((a, b) for k, a, b in plain if k == kind) for kind in KINDS}
    for kind, a, b in disguised_spans(text):
        at = bisect_right(taken[kind], (a, b))  # spans of a kind do not overlap, so only its neighbours matter
        if (at == 0 or taken[kind][at - 1][1] <= a) and (at == len(taken[kind]) or b <= taken[kind][at][0]):
            taken[kind].insert(at, (a, b))
    return sorted(plain, key=order), [(kind, a, b) for kind in KINDS for a, b in taken[kind]]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_base) of every row.

    Counts are those of `spans`, disguised ones included; `base_sha256` and `n_base` cover the plain ones alone. A null
    or empty text has no spans; repeated rows are reported each. Map-only.
    """
    def work(batches):
        for batch in batches:
            rows = [all_spans(t or "") for t in batch.column(1).to_pylist()]
            counts = [[sum(s[0] == kind for s in every) for _, every in rows] for kind in KINDS]
            sha = [hashlib.sha256(joined(plain).encode()).hexdigest() for plain, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()),
                 pa.array([joined(every) for _, every in rows], pa.string()),
                 pa.array([len(plain) for plain, _ in rows], pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_base"])

    return map_texts(docs.select(F.col("doc_id").cast("bigint"), "text"), work,
                     "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                     "base_sha256 string, spans string, n_base bigint")


def redact_text(text: str) -> str:
    """The text with each span, overlapping ones of different kinds taken together, replaced by the kind in brackets."""
    spans = sorted(all_spans(text)[1], key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    while spans:
        kind, a, b = spans.pop(0)
        while spans and spans[0][1] < b:
            b = max(b, spans.pop(0)[2])
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """`docs` with personal data in `text` replaced; `length`, if named, becomes the new number of characters.

    Null texts stay null. All other columns pass through.
    """
    names = docs.columns

    def work(batches):
        for batch in batches:
            new = [None if t is None else redact_text(t) for t in batch.column(names.index(text)).to_pylist()]
            columns = list(batch.columns)
            columns[names.index(text)] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    done = map_texts(docs, work, docs.schema)
    if length is None:
        return done
    return done.withColumn(length, F.coalesce(F.length(text).cast(docs.schema[length].dataType), F.col(length)))
