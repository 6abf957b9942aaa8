"""A landing has as many files as its table has splits, and its stream no more batches than before."""

import os

import issueloom.registry.streams  # noqa: F401
from issueloom.registry.base import QUERIES
from issueloom.session import run_folder


def test_landing_follows_the_table(spark, tmp_path):
    rows = [(i, f"Title {i}. text {i}", "en", f"src{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = run_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        found = QUERIES["k2_stream_dedupe"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.title for r in found) == sorted(f"Title {i}" for i in range(60))
    run, = [d for d in set(os.listdir(folder)) - before if d.startswith("stream-")]
    assert len([f for f in os.listdir(f"{folder}/{run}/landing") if f.endswith(".parquet")]) >= 12
    assert len([f for f in os.listdir(f"{folder}/{run}/state/commits") if f.isdigit()]) <= 4
