"""Titles inside titles: all of them, and no exploded table is sent to the driver."""

import random

from pyspark.sql import functions as F

from issueloom.operators.tracking import contained_pairs


def exploded_in_broadcast(plan):
    inside = []
    for line in plan.splitlines():
        depth = next((i for i, c in enumerate(line) if c.isalpha() or c == "*"), len(line))
        inside = [d for d in inside if d < depth]
        if "BroadcastExchange" in line:
            inside.append(depth)
        elif "Generate " in line and inside:
            return True
    return False


def test_titles_inside_titles(spark, tmp_path):
    r = random.Random(8)
    titles = ["".join(r.choice("ab c") for _ in range(r.randint(0, 14))) for _ in range(120)]
    tables = []
    for side in ("short", "long"):
        rows = [(f"{side}{i}", t) for i, t in enumerate(titles[::2] if side == "short" else titles)]
        spark.createDataFrame(rows, "id string, s string").write.parquet(f"{tmp_path}/{side}")
        tables.append((rows, spark.read.parquet(f"{tmp_path}/{side}")))
    (short, a), (long, b) = tables
    pairs = contained_pairs(a, b)
    want = {(i, j) for i, s in short for j, t in long if s and s in t}
    assert {tuple(p) for p in pairs.collect()} == want and len(want) > 60
    assert not exploded_in_broadcast(contained_pairs(a, b)._jdf.queryExecution().executedPlan().toString())
