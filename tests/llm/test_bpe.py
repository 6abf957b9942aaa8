import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from issueloom.llm import bpe
from tests.llm.cases import documents, tricky_texts, with_clashes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
OWN = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library(text):
    ids = OWN.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=10), st.data())
def test_appends_and_edits_equal_a_fresh_encoding(data, more, draw):
    v = OWN.vocabulary
    assert bpe.PrefixTable(v, data).append(more).last == bpe.PrefixTable(v, data + more).last
    a = draw.draw(st.integers(0, len(data)))
    b = draw.draw(st.integers(a, len(data)))
    table = bpe.PrefixTable(v, data)
    table.replace(a, b, more)
    assert table.data == data[:a] + more + data[b:] and table.last == bpe.PrefixTable(v, table.data).last


def test_an_edit_of_a_long_piece_is_worked_out_near_it_only():
    r = random.Random(4)
    data = bytes(r.choice(b"abcdefgh") for _ in range(5000))
    assert bpe.PrefixTable(OWN.vocabulary, data).replace(2000, 2001, b"zz") < 300


@settings(max_examples=150, deadline=None)
@given(st.text("ab '!ser\n1 é", max_size=30), st.text("ab 's\n1!", max_size=6), st.data())
def test_editable_text(text, new, draw):
    a = draw.draw(st.integers(0, len(text)))
    b = draw.draw(st.integers(a, len(text)))
    kept = bpe.EditableText(OWN, text)
    kept.replace(a, b, new)
    assert kept.ids() == THEIRS.encode_ordinary(text[:a] + new + text[b:])
    kept.append(new)
    assert kept.ids() == THEIRS.encode_ordinary(text[:a] + new + text[b:] + new)


def test_round_trip_of_every_row(spark):
    rows = tricky_texts()
    got = bpe.round_trip(with_clashes(documents(spark, rows)), PATH, public_tokenizers.PATTERN).collect()

    def want(i, t):
        ids = THEIRS.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert sorted(map(tuple, got), key=repr) == sorted((want(i, t) for i, t in rows), key=repr)
    assert bpe.round_trip(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
    coded = bpe.encode(with_clashes(documents(spark, rows)), PATH, public_tokenizers.PATTERN)
    back = bpe.decode(coded, PATH).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(t or "" for _, t in rows)
