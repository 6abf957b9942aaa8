"""Refinement passes with bounds, against passes that compare everything; and paging and silences against plain lists."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from issueloom.operators import grouping as G
from issueloom.operators import search, similarity
from issueloom.streaming import articles as S


def plain_passes(vectors, leaders, window, threshold, passes):
    for _ in range(passes):
        means = {g: vectors[[i for i in leaders if leaders[i] == g]].mean(axis=0) for g in set(leaders.values())}
        new = {}
        for i in leaders:
            scores = [(round(float(vectors[i] @ m), 9), f"a{g:03d}", g) for g, m in means.items() if window(g) == window(i)]
            best = max(s for s in scores)
            new[i] = best[2] if best[0] >= threshold else leaders[i]
        leaders = new
    return leaders


@pytest.mark.parametrize("passes", [1, 3])
def test_bounds_change_no_result(spark, monkeypatch, passes):
    r = np.random.default_rng(8)
    centres = r.standard_normal((14, 24))
    vectors = np.vstack([c + 0.75 * r.standard_normal((12, 24)) for c in centres])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[5] = 0
    window = lambda i: i // 84
    given = {i: int(r.integers(0, 12)) + 84 * window(i) for i in range(len(vectors))}  # a poor start: much moves
    nodes = spark.createDataFrame([(window(i), f"a{i:03d}", i, v.tolist()) for i, v in enumerate(vectors)],
                                  "window int, id string, rank bigint, vector array<double>")
    grouped = spark.createDataFrame([(window(i), f"a{i:03d}", f"a{g:03d}", 1.0) for i, g in given.items()],
                                    "window int, article_id string, leader_id string, score double")
    probes, plain = [], G.similar_pairs

    def counted(probe, index, *args, **kind):
        probes.append(probe.count())
        return plain(probe, index, *args, **kind)
    monkeypatch.setattr(G, "similar_pairs", counted)
    articles = nodes.select("id", F.col("vector").alias("embedding"))
    got = {int(x.article_id[1:]): int(x.leader_id[1:]) for x in G.refine_groups(grouped, nodes, articles, 0.6, passes).collect()}
    assert got == plain_passes(vectors, given, window, 0.6, passes)
    assert probes[0] == len(vectors)


def test_settled_articles_meet_no_means_again(spark, monkeypatch):
    r = np.random.default_rng(9)
    centres = np.linalg.qr(r.standard_normal((24, 24)))[0][:10]
    vectors = np.vstack([c + 0.05 * r.standard_normal((20, 24)) for c in centres])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(0, f"a{i:03d}", i, v.tolist()) for i, v in enumerate(vectors)],
                                  "window int, id string, rank bigint, vector array<double>")
    # one article of each group starts in the next one
    grouped = spark.createDataFrame([(0, f"a{i:03d}", f"a{(i // 20 + (i % 20 == 7)) % 10 * 20:03d}", 1.0) for i in range(200)],
                                    "window int, article_id string, leader_id string, score double")
    probes, plain = [], G.similar_pairs

    def counted(probe, index, *args, **kind):
        probes.append(probe.count())
        return plain(probe, index, *args, **kind)
    monkeypatch.setattr(G, "similar_pairs", counted)
    out = G.refine_groups(grouped, nodes, nodes.select("id", F.col("vector").alias("embedding")), passes=3)
    assert {x.article_id: x.leader_id for x in out.collect()} == {f"a{i:03d}": f"a{i // 20 * 20:03d}" for i in range(200)}
    assert probes[0] == 200 and probes[1] < 20 and probes[2] < 20


@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_pages_by_ranges_equal_a_whole_sort(spark, slice_rows):
    r = random.Random(3)
    rows = [(i, r.choice([None, 1, 2, 3]), "x" * i) for i in range(211)]
    df = spark.createDataFrame(rows, "id int, v int, text string").repartition(5)
    order = [F.col("v").desc_nulls_last(), F.asc("id")]
    want = sorted(rows, key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))
    for page in (1, 11, 22, 99):
        got, numbers = search.paginate(df, order, page, 10, key=["id"], by=["v", "id"], shallow=0, slice_rows=slice_rows)
        low = (numbers["page"] - 1) * 10
        assert [tuple(x) for x in got.collect()] == want[low:low + 10]
        assert numbers == {"page": min(page, 22), "page_size": 10, "page_count": 22, "total_count": 211}
    none, numbers = search.paginate(df.limit(0), order, 3, 10, key=["id"], by=["v", "id"], shallow=0)
    assert none.count() == 0 and numbers["page_count"] == 1


def test_silences_over_many_batches_with_late_arrivals(spark, tmp_path):
    """Arrivals come in eight files, up to the delay out of order; one source stops early, and some have repeats."""
    r = random.Random(1)
    hour, begin = 3600, 1_700_000_000
    events = []
    for source in range(6):
        t = begin + r.randint(0, 5 * hour)
        while t < begin + (40 if source == 0 else 200) * hour:
            events.append((source, t))
            t += r.choice([1, 2, 5, 11, 13, 20, 40]) * hour + r.randint(0, 60)
    events += events[::9]
    events.sort(key=lambda e: e[1] + r.randint(0, 90 * 60))
    size = -(-len(events) // 8)
    for k in range(8):
        part = spark.createDataFrame(events[k * size:(k + 1) * size], "source int, t bigint").select(
            "source", F.timestamp_seconds("t").alias("at")).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.landed(spark, str(tmp_path / "in"), part.schema, files=1)
    found = S.silences(stream, "at", "source")
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((x.source, int(x.last_seen.replace(tzinfo=datetime.timezone.utc).timestamp())) for x in
                 spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())
    mark, want = max(t for _, t in events) - 2 * hour, []
    for source in range(6):
        times = sorted({t for s, t in events if s == source})
        want += [(source, a) for a, b in zip(times, [*times[1:], None]) if (b is None or b > a + 12 * hour) and a + 12 * hour < mark]
    assert got == sorted(want) and len(want) > 10
