"""Streams of arriving articles and events."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from issueloom.schema import ARTICLES
from issueloom.sources.partitioned import merge_batch
from issueloom.sources.store import merge_ingest

KOREA_OFFSET = "15 hours"  # Korea midnight is 15:00 UTC


def landed(spark: SparkSession, path: str, schema: StructType = ARTICLES, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files).parquet(path))


def stream_ingest(source: DataFrame, store: str, checkpoint: str, keep_exclusion: bool = False, as_of: Column | None = None
                  ) -> StreamingQuery:
    """Merge each micro-batch into the partitioned article store under `store`.

    A batch writes only the partitions it touches, and reads the store as the batch before it left it; so with `as_of`
    given a replayed batch writes the same rows again. Read the store with `read_store`.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        now = F.current_timestamp() if as_of is None else as_of
        merge_batch(batch.sparkSession, store, batch_id, batch,
                    lambda stored, arrived: merge_ingest(stored, arrived, now, keep_exclusion=keep_exclusion))

    return (source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def before(spark: SparkSession, store: str, batch_id: int, schema: StructType) -> DataFrame:
    """The newest snapshot older than `batch_id`, or no rows."""
    older = [n for n in snapshots(spark, store) if int(n) < batch_id]
    return spark.read.schema(schema).parquet(f"{store}/{older[-1]}") if older else spark.createDataFrame([], schema)


def prune(spark: SparkSession, store: str, batch_id: int) -> None:
    """Remove the snapshots that not even a replay of `batch_id` reads."""
    for name in [n for n in snapshots(spark, store) if int(n) < batch_id][:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def snapshots(spark: SparkSession, store: str) -> list[str]:
    """Numbers of the finished snapshots under `store`, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((n for n in done if n.isdigit()), key=int)


def latest_snapshot(spark: SparkSession, store: str, schema: StructType = ARTICLES) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{store}/{snapshots(spark, store)[-1]}")


def stream_dedupe(source: DataFrame, key: str = "id", time: str = "published_at", delay: str = "40 days") -> DataFrame:
    """The first row per key, as long as repeats come within `delay`."""
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(source: DataFrame, time: str, by: list[str], delay: str = "2 days") -> DataFrame:
    """Arrivals per Korea day and `by`."""
    day = F.window(time, "1 day", "1 day", KOREA_OFFSET)
    return source.withWatermark(time, delay).groupBy(day.alias("w"), *by).agg(F.count("*").alias("arrivals"))


def week_counts(source: DataFrame, time: str, by: list[str], delay: str = "8 days") -> DataFrame:
    """Arrivals in the seven days up to every Korea midnight."""
    week = F.window(time, "7 days", "1 day", KOREA_OFFSET)
    return source.withWatermark(time, delay).groupBy(week.alias("w"), *by).agg(F.count("*").alias("arrivals"))


def last_seen(source: DataFrame, time: str, by: str) -> DataFrame:
    return source.groupBy(by).agg(F.max(time).alias("last_seen"))


def stale_sources(seen: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    """Sources that have been silent for longer than `hours`."""
    return seen.filter(F.col("last_seen") < as_of - F.expr(f"INTERVAL {hours} HOURS"))


def silences(source: DataFrame, time: str, by: str, hours: int = 12, delay: str = "2 hours") -> DataFrame:
    """(`by`, last_seen, silent_from): each time a source falls silent for longer than `hours`, as event time passes that point.

    A source's state are the stretches of its arrivals that `delay` may still join or part, a few numbers; stretches whose
    silence no late arrival can fill any more are given out and forgotten. A timer on event time wakes sources that no longer
    arrive, so a silence is reported when it happens and not when someone asks.
    """
    wait = hours * 3_600_000
    kind = source.schema[by].dataType.simpleString()

    def work(key, frames, state):
        spans = [list(s) for s in zip(*state.get)] if state.exists else []  # (first, last) in milliseconds, more than `wait` apart
        times = np.unique(np.concatenate([f["_at"].to_numpy(np.int64) for f in frames] or [np.zeros(0, np.int64)]))
        merged: list[list[int]] = []
        for first, last in sorted(spans + [[t, t] for t in times.tolist()]):
            if merged and first <= merged[-1][1] + wait:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        now, out = state.getCurrentWatermarkMs(), []
        while merged and merged[0][1] + wait < now:
            out.append(merged.pop(0)[1])
        if merged:
            state.update(([m[0] for m in merged], [m[1] for m in merged]))
            state.setTimeoutTimestamp(max(merged[0][1] + wait, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({by: [key[0]] * len(out), "last_ms": out})

    timed = source.withWatermark(time, delay).select(F.col(by), F.col(time), F.unix_millis(time).alias("_at"))
    found = timed.groupBy(by).applyInPandasWithState(
        work, f"{by} {kind}, last_ms bigint", "first array<bigint>, last array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(by, F.timestamp_millis("last_ms").alias("last_seen"), F.timestamp_millis(F.col("last_ms") + wait).alias("silent_from"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], mode: str = "update") -> StreamingQuery:
    """Run an aggregate stream over what has landed into snapshots under `path`: changed rows replace those of equal `keys`.

    In update and append mode the watermark frees state that can no longer change; what it counted stays in the table.
    """
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = before(spark, path, batch_id, schema).join(batch.select(*keys), keys, "left_anti")
        kept.select(*batch.columns).unionByName(batch).write.mode("overwrite").parquet(f"{path}/{batch_id}")
        prune(spark, path, batch_id)

    return (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
