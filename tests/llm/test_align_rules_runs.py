"""Token alignment, rules by host and periodic runs, each against a plain Python statement of its result."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from issueloom.llm import align, hosts, queries, runs
from tests.llm.cases import documents, rows_of, tricky_texts, with_clashes, words

FILES = public_tokenizers.path(queries.BYTE_LEVEL), public_tokenizers.path(queries.PIECES), public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- alignment -------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def plain_alignment(libraries, text):
    """(ids of A, ids of B, groups, links) by walking both lists of tokens."""
    a, b = libraries
    if not text:
        return [], [], [], []
    code = {}
    for byte in range(256):  # the visible character of each byte
        plain = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte
        code[chr(byte) if plain else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x) for x in range(byte)))] = byte
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    links = [(x, y) for x, e in zip(ids_a, ends_a) for y, f in zip(ids_b, ends_b) if e == f] if len(ids_a) < 400 else [
        (g[-1], h[-1]) for g, h in groups]
    return ids_a, ids_b, groups, links


def plain_digest(libraries, texts):
    found = [plain_alignment(libraries, t) for t in texts]
    counts = Counter(link for f in found for link in f[3])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for a, b, groups, links in found:
        joined = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
               hashlib.sha256(joined.encode()).hexdigest() if a else "")


ALIGN_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check_alignment(spark, libraries, rows, **options):
    found = align.alignment_digest(documents(spark, rows), *FILES, **options).select("doc_id", *ALIGN_COLUMNS)
    wanted = [(i, *d) for (i, _), d in zip(rows, plain_digest(libraries, [t for _, t in rows]))]
    assert rows_of(found) == sorted(wanted, key=repr)


def test_alignment_equals_the_plain_walk(spark, libraries):
    check_alignment(spark, libraries, tricky_texts())


@pytest.mark.parametrize("size", [7, 64])
def test_ranges_of_any_size_give_the_same_alignment(spark, libraries, size):
    odd = [(20, "<|endoftext|> and <s> are plain text here, x = ▁ is not"), (21, "▁"), (22, "東京都" * 40), (23, "q" * 300),
           (24, "\x00\x01 \n\n\t  tabs"), (25, words(3, 150)), (25, words(3, 150)), (None, words(4, 90)), (26, "é" * 70 + "🙂" * 30)]
    check_alignment(spark, libraries, odd, size=size)


def test_alignment_of_whole_documents(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = queries.QUERIES["op11_token_alignment"](spark, DATA).select("doc_id", *ALIGN_COLUMNS)
    wanted = [(i, *d) for (i, _), d in zip(docs, plain_digest(libraries, [t for _, t in docs]))]
    assert rows_of(found) == sorted(wanted, key=repr)
    assert {f.name: f.dataType.simpleString() for f in found.schema.fields if f.name != "groups_sha256"} == dict.fromkeys(
        ["doc_id", *ALIGN_COLUMNS[:-1]], "bigint")


def test_alignment_of_empty_and_clashing_tables(spark, libraries):
    none = documents(spark, [])
    assert align.alignment_digest(none, *FILES).count() == 0
    rows = [(1, "one two three"), (2, None)]
    clashing = with_clashes(documents(spark, rows)).withColumn("links", F.lit(1)).withColumn("no", F.lit(1)).withColumn("n_a", F.lit(1))
    found = align.alignment_digest(clashing, *FILES).select("doc_id", *ALIGN_COLUMNS)
    assert rows_of(found) == sorted([(i, *d) for (i, _), d in zip(rows, plain_digest(libraries, [t for _, t in rows]))], key=repr)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é東🙂\n", max_size=60), st.lists(st.integers(0, 40), max_size=8), st.randoms())
def test_fragments_are_a_monoid(text, marks, r):
    """Any cut into ranges, composed in any order of neighbours, gives the fragment of the whole."""
    of = align.pair(*FILES)
    (a, b), = of.tokens([text])
    if not len(a):
        return
    ends_a, ends_b = np.cumsum(of.a_sizes[a]), np.cumsum(of.b_sizes[b])
    edges = [0, *sorted(m for m in marks if m < ends_a[-1]), int(ends_a[-1])]
    parts = []
    for low, high in zip(edges, edges[1:]):
        x, y = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
        parts.append(align.fragment(of, a[x], ends_a[x], b[y], ends_b[y]))
    whole = align.finish(of, align.fragment(of, a, ends_a, b, ends_b))
    parts.insert(r.randrange(len(parts) + 1), align.Fragment())
    while len(parts) > 1:
        i = r.randrange(len(parts) - 1)
        parts[i:i + 2] = [align.compose(of, parts[i], parts[i + 1])]
    groups, links = align.finish(of, parts[0])
    assert groups == whole[0] and links.tolist() == whole[1].tolist()


def test_both_encoders_of_a_agree(monkeypatch):
    of, r = align.pair(*FILES), random.Random(4)
    signs = ["a", "B", " ", "  ", "\n", "'s", "'S", "é", "東", "1", "٣", "!", "\u00a0", "\u200b", "\u3000", "\x85", "<|endoftext|>", "e\u0301"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(500)]
    texts += [" " * 90_000 + "x", "\n" * 50_000 + "\u3000" * 49_000 + "y", "q" * 90_000]
    fast = [of.a_ids(t) for t in texts]
    monkeypatch.setattr(align, "FAST_CHARS", -1)
    assert fast == [of.a_ids(t) for t in texts]
    assert len(of.a_ids(" " * 1_500_000 + "x")) == 1_500_000


def test_no_more_pairs_than_the_bound(spark):
    links = spark.createDataFrame([(1, [1, 2, 3]), (2, [3])], "doc_id bigint, links array<bigint>")
    assert align.with_counts(links, 3).count() == 2
    with pytest.raises(ValueError):
        align.with_counts(links, 2)


# ---- rules by host ---------------------------------------------------------------------------------------------

def plain_counts(text):
    w, text = split(text), text or ""
    lines = [line for line in text.split("\n") if split(line)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside))


def rule_rows():
    line = words(7, 10)
    return tricky_texts() + [(30, "\n".join([line, "other words here", line, line])), (31, line + " " + line), (32, "a " * 50),
                             (33, "# $ % & * | < > x"), (34, "x\ny\nx \nx\n\n\n \t\ny"), (35, words(8, 40) + " " + words(8, 9))]


def test_counts_equal_plain_ones(spark):
    found = hosts.rule_counts(documents(spark, rule_rows())).drop("host")
    assert rows_of(found) == sorted([(i, *plain_counts(t)) for i, t in rule_rows()], key=repr)


def host_docs(spark, hosts_of):
    """Texts of a host: (host, number of texts, how many of them fail)."""
    rows, n = [], 0
    for host, texts, bad in hosts_of:
        for k in range(texts):
            rows.append((n, words(n, 3 if k < bad else 60), "en", host, 0))
            n += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_rates_are_shrunk_towards_what_hosts_are_like(spark):
    docs = host_docs(spark, [("good", 60, 3), ("bad", 60, 57), ("mixed", 60, 20), ("tiny", 1, 1), ("fine", 40, 1), (None, 5, 5), (" ", 3, 3)])
    counts = hosts.rule_counts(docs)
    rates = {r.host: r.rate for r in hosts.host_rates(counts).filter("rule = 'few_words'").collect()}
    assert set(rates) == {"good", "bad", "mixed", "tiny", "fine"}
    # the method of moments, by hand
    n, k = np.array([60, 60, 60, 1, 40.]), np.array([3, 57, 20, 1, 1.])
    p = k.sum() / n.sum()
    rho = ((n * (k / n - p) ** 2).sum() - p * (1 - p) * 4) / (n.sum() - (n * n).sum() / n.sum()) / (p * (1 - p))
    m = 1 / rho - 1
    for host, x, y in zip(["good", "bad", "mixed", "tiny", "fine"], n, k):
        assert rates[host] == pytest.approx((y + m * p) / (x + m), abs=1e-8)
    verdicts = hosts.judge(docs).join(docs.select("doc_id", "source"), "doc_id")
    gone = verdicts.filter("host_rejected").select("source").distinct().collect()
    assert "bad" in {r.source for r in gone} and not {"good", "mixed", "fine", None, " "} & {r.source for r in gone}
    assert verdicts.filter("source = 'bad' and kept").count() == 0
    assert verdicts.filter("source = 'good' and kept").count() == 57
    assert verdicts.filter("source is null and kept").count() == 0  # short ones fail by themselves


def test_hosts_that_do_not_differ_or_stand_alone(spark):
    same = hosts.host_rates(hosts.rule_counts(host_docs(spark, [(f"h{i}", 10, 4) for i in range(5)])))
    assert {round(r.rate, 3) for r in same.filter("rule = 'few_words'").collect()} == {0.4}
    alone = hosts.host_rates(hosts.rule_counts(host_docs(spark, [("h", 8, 2)])))
    assert [r.rate for r in alone.filter("rule = 'few_words'").collect()] == [0.25]


def test_host_rules_on_tricky_tables(spark):
    found = {}
    for row in hosts.judge(with_clashes(documents(spark, tricky_texts())).withColumn("host", F.lit("x")).withColumn("part", F.lit("y"))).collect():
        found.setdefault(row.doc_id, []).append(row)
    assert sorted((r.n_words for r in found[5])) == [6000, 6000] and len(found[None]) == 2
    assert hosts.judge(documents(spark, [])).count() == 0
    for rows in found.values():
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert r.kept == (not r.base_failed and not r.host_rejected)


# ---- periodic runs ---------------------------------------------------------------------------------------------

def plain_runs(w):
    """Every lag over the whole text; a stretch counts if no smaller period fits it."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            end = i
            while end < len(w) and w[end] == w[end - q]:
                end += 1
            start, length = i - q, end - i + q
            if length >= max(12, 2 * q) and not any(all(w[x] == w[x - p] for x in range(start + p, end)) for p in range(1, q)):
                out.append((start, length, q))
            i = end + 1
    return sorted(out)


def plain_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(r):
    w, n, k = [], r.randint(0, 120), r.choice([1, 2, 2, 3, 6, 40])
    while len(w) < n:
        kind = r.random()
        if kind < 0.4 or not w:
            w += [str(r.randint(0, k)) for _ in range(r.randint(1, 12))]
        elif kind < 0.8:
            p = r.randint(1, min(len(w), 30))
            for _ in range(r.randint(1, 50)):
                w.append(w[-p])
        else:
            a = r.randint(0, len(w) - 1)
            w += w[a:a + r.randint(1, 25)]
    return w[:n]


def test_runs_equal_brute_force_on_random_texts():
    r = random.Random(11)
    for _ in range(400):
        lists = [random_words(r) for _ in range(3)]
        found, _ = runs.text_runs([" ".join(w).encode() for w in lists])
        assert found == [plain_runs(w) for w in lists]


@pytest.mark.parametrize("pattern", ["a", "a b", "a a b", "fibonacci", "two blocks", "nested"])
def test_runs_of_long_periodic_texts_are_read_in_time(pattern):
    w = (pattern + " ").split() * 40_000
    if pattern == "fibonacci":
        a, b = ["a"], ["a", "b"]
        while len(b) < 40_000:
            a, b = b, b + a
        w = b
    elif pattern == "two blocks":
        w = ["a"] * 40_000 + ["x"] + ["a"] * 40_000
    elif pattern == "nested":
        w = ((["a"] * 20 + ["b"]) * 30 + ["c"]) * 60
    (found,), _ = runs.text_runs([" ".join(w).encode()])
    assert found and all(w[s + q:s + n] == w[s:s + n - q] for s, n, q in found[:50])
    if pattern == "nested":
        assert (0, len(w), 631) in found and (0, 20, 1) in found and (0, 630, 21) in found


def test_runs_on_tricky_tables(spark):
    rows = tricky_texts() + [(40, "x y z " * 10), (40, "x y z " * 10), (41, "a\tb\n" * 8 + "\x0bc"), (42, "A a " * 12), (43, "é " * 12)]
    found = runs.find_runs(with_clashes(documents(spark, rows)).withColumn("runs", F.lit("x")))
    wanted = []
    for i, t in rows:
        every = plain_runs(split(t)) if len(t or "") < 5000 else []
        left = plain_collapsed(split(t), every)
        wanted.append((i, len(split(t)), every, left, hashlib.sha256(left.encode()).hexdigest()))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.collapsed_sha256) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert runs.find_runs(documents(spark, [])).count() == 0
    digest = {r.doc_id: r for r in runs.run_digest(found).collect()}
    assert (digest[40].start, digest[40].length, digest[40].period, digest[40].exponent_milli) == (0, 30, 3, 10000)
    assert digest[2].start is None and digest[2].period is None and digest[2].exponent_milli is None
    assert digest[2].runs_sha256 == digest[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_periodic_runs_query_equals_brute_force(spark):
    wanted = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        w = split(r.text)
        h = zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        every = plain_runs_fast(w)
        best = min(every, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in every)
        wanted.append((r.doc_id, len(every), *best, None if best[0] is None else 1000 * best[1] // best[2],
                       hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(w, every).encode()).hexdigest()))
    found = queries.QUERIES["op13_periodic_runs"](spark, DATA).drop("n_words")
    assert rows_of(found) == sorted(wanted, key=repr)


def plain_runs_fast(w):
    """`plain_runs` with the comparison of a lag in numpy."""
    ids = np.unique(np.array(w or [""], object).astype(str), return_inverse=True)[1] if w else np.zeros(0, int)
    out = []
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        for i, end in zip(np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])):
            start, length, end = int(i), int(end - i + q), int(end + q)
            if length >= max(12, 2 * q) and not any((ids[start + p:end] == ids[start:end - p]).all() for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out)
