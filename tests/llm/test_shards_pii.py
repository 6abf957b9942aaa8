import re
import time
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from issueloom.llm import pii, shards
from tests.llm.cases import documents, tricky_texts, with_clashes


def jump(key, n):
    """The published loop."""
    key, b, j = (key or 0) % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(spark):
    rows = tricky_texts() + [(i, "t") for i in (2**63 - 1, -2**63, *range(100, 400))]
    got = shards.shard_documents(with_clashes(documents(spark, rows)), 40).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 40), jump(r.doc_id, 41)) and r.grown_shard in (r.shard, 40)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    assert shards.shard_documents(documents(spark, []), 40).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda m: [int(c) for c in m.group() if c.isdigit()]
    luhn = lambda d: sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text("ab.@@+-  ()0123456789129", max_size=45))
def test_plain_spans_equal_the_patterns(text):
    assert pii.plain_spans(text) == brute(text)
    plain, every = pii.all_spans(text)
    assert set(plain) <= set(every)


def test_disguises_map_back_to_the_source():
    cases = {
        "mail john.doe at example dot com now": ("email", "john.doe at example dot com"),
        "jane [at] mail [dot] example (dot) org": ("email", "jane [at] mail [dot] example (dot) org"),
        "ｊｏｅ＠ｍａｉｌ．ｃｏｍ": ("email", "ｊｏｅ＠ｍａｉｌ．ｃｏｍ"),
        "аdmin@exаmple.com": ("email", "аdmin@exаmple.com"),  # Cyrillic letters
        "call plus one five five five one two three four five six seven": (
            "phone", "plus one five five five one two three four five six seven"),
        "ip one nine two dot one six eight dot zero dot one": ("ip", "one nine two dot one six eight dot zero dot one"),
        "4111​1111​1111​1111": ("card", "4111​1111​1111​1111"),
    }
    for text, (kind, source) in cases.items():
        assert [(k, text[a:b]) for k, a, b in pii.all_spans(text)[1]] == [(kind, source)], text
    for text in ("meet me at example.com", "polka dot dress at noon", "one two", "é at ñ. Oui", "nine to five"):
        assert pii.all_spans(text)[1] == []
    assert pii.redact_text("a@b.co, +1 (243) 555-5526") == "<email>, <phone>"


def test_long_runs_of_zeros_in_an_address():
    zeros = "0" * 5000
    for text, found in ((f"{zeros}.1.2.3", True), (f"10.{zeros}255.0.{zeros}", True), (f"{zeros}256.1.2.3", False), (f"1.2.3.4{zeros}", False)):
        assert [s for s in pii.plain_spans(text) if s[0] == "ip"] == ([("ip", 0, len(text))] if found else [])
        assert pii.redact_text(text).startswith("<ip>") == found


def test_long_runs_are_read_in_time():
    for text in ("a" * 300_000, "1" * 300_000, "a." * 100_000 + "@", "+1" + " " * 200_000, "one " * 50_000, "( " * 50_000):
        pii.all_spans(text)


@pytest.mark.parametrize("text", [
    "(x)" + " " * 2_000_000, "(x)" + "\n" * 2_000_000 + "(", "( " * 200_000, "(" + " " * 1_000_000 + "at", "x at y" + " " * 1_000_000,
    "x at y" + " " * 500_000 + "(" + " " * 500_000 + "dot", "[" * 500_000, "x " + "at " * 200_000, "dot" * 200_000 + " at " + "dot" * 200_000,
    "one one one" + " " * 1_000_000 + "x", "plus" + " -" * 500_000, " (at) " * 100_000, "a@b.cc (x) \n " * 30_000 + "two three one at x dot yy"])
def test_blanks_and_brackets_are_read_in_time(text):
    begin = time.time()
    pii.all_spans(text)
    assert time.time() - begin < 4


def test_brackets_after_blanks_of_another_match():
    for text, span in (("x (at) (dot) y", []), ("ann (at) b.cc", [("email", 0, 13)]), ("ann (at)  (x) b (dot) cc", []),
                       ("ann\n[at]\t b [ dot ] cc", [("email", 0, 22)]), ("ann ( at ) b (dot) (dot) cc", [])):
        assert pii.all_spans(text)[1] == span, text


@settings(max_examples=300, deadline=None)
@given(st.text("ab1 (x", max_size=30), st.randoms())
def test_rewritten_text_maps_back_as_two_full_tables_do(text, r):
    """Against start and stop of every character, over three rewritings."""
    mapped, start, stop = pii.Mapped(text), list(range(len(text))), list(range(1, len(text) + 1))
    for pattern in (r"a+", r"\s*\(\s*", r"1|bx"):
        puts = {}

        def new(m, puts=puts):
            parts = r.choice([[], [("Q", *m.span())], [("QR", *m.span())], [("Q", m.start(), m.start() + 1), ("STU", m.end() - 1, m.end())]])
            puts[m.span()] = parts
            return parts
        before = mapped.text
        mapped = mapped.rewrite(re.compile(pattern), new)
        starts, stops, out, at = [], [], [], 0
        for (low, high), parts in puts.items():
            out.append(before[at:low])
            starts += start[at:low]
            stops += stop[at:low]
            for put, a, b in parts:
                out.append(put)
                starts += [start[a]] * len(put)
                stops += [stop[b - 1]] * len(put)
            at = high
        start, stop = starts + start[at:], stops + stop[at:]
        assert mapped.text == "".join(out) + before[at:]
        for _ in range(10):
            if mapped.text:
                a = r.randrange(len(mapped.text))
                b = r.randint(a + 1, len(mapped.text))
                assert mapped.source(a, b) == (start[a], stop[b - 1])


def test_all_rows(spark):
    rows = tricky_texts() + [(20, "x@y.zz and x at y dot zz"), (20, "x@y.zz and x at y dot zz")]
    got = pii.find(with_clashes(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    last = [r for r in got if r.doc_id == 20]
    assert len(last) == 2 and last[0].n_email == 2 and last[0].n_base == 1 and last[0].spans == "email:0:6,email:11:24"
    assert pii.find(documents(spark, [])).count() == 0
    out = pii.redact(with_clashes(documents(spark, rows)), length="n_chars")
    assert out.columns == with_clashes(documents(spark, rows)).columns
    assert out.filter("doc_id = 20").first().text == "<email> and <email>" and out.filter("doc_id = 20").first().n_chars == 19
    assert out.filter(F.col("text").isNull()).count() == 2
