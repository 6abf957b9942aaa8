"""The article store in partitions, of which a merge writes only those that it touches.

An article lies in the partition of the day it was first seen, which no later arrival changes, and of its id's bucket. A batch
reads the ids of the buckets it has ids in, rewrites the partitions that hold one of them or that a new one belongs to, and
leaves a manifest: which batch wrote the partition that counts. Readers follow the newest manifest, so they see a batch wholly or
not at all, and a batch that is run again writes what it wrote before over it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from issueloom.schema import ARTICLES, I, L, S, table
from issueloom.session import materialize

BUCKETS = 4  # of a day; a store keeps the number it began with
PLACE = table(in_day=S, in_bucket=I, in_batch=L)
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def batches(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the finished batches, oldest first."""
    done = []
    for name in _children(spark, f"{store}/manifest"):
        fs, mark = _fs(spark, f"{store}/manifest/{name}/_SUCCESS")
        if name.isdigit() and fs.exists(mark):
            done.append(int(name))
    return sorted(done)


def manifest(spark: SparkSession, store: str, batch: int | None = None) -> dict[tuple[str, int], int]:
    """(day, bucket) -> batch that wrote it, after `batch` or the newest; as many entries as there are partitions."""
    known = [b for b in batches(spark, store) if batch is None or b <= batch]
    if not known:
        return {}
    rows = spark.read.schema(PLACE).parquet(f"{store}/manifest/{known[-1]}").collect()
    return {(r.in_day, r.in_bucket): r.in_batch for r in rows}


def _partition(store: str, key: tuple[str, int], batch: int) -> str:
    return f"{store}/data/in_batch={batch}/in_day={key[0]}/in_bucket={key[1]}"


def _read(spark: SparkSession, store: str, parts: dict[tuple[str, int], int], schema: StructType) -> DataFrame:
    """The rows of some partitions, with in_day and in_bucket."""
    typed = StructType([*schema.fields, *PLACE.fields])
    if not parts:
        return spark.createDataFrame([], typed).drop("in_batch")
    paths = [_partition(store, key, batch) for key, batch in sorted(parts.items())]
    return spark.read.schema(typed).option("basePath", f"{store}/data").parquet(*paths).drop("in_batch")


def read_store(spark: SparkSession, store: str, schema: StructType = ARTICLES, batch: int | None = None) -> DataFrame:
    """The stored rows, after `batch` or the newest one."""
    return _read(spark, store, manifest(spark, store, batch), schema).drop("in_day", "in_bucket")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _day(time: str) -> Column:
    return F.coalesce(F.date_format(F.to_utc_timestamp(F.col(time), F.current_timezone()), "yyyy-MM-dd"), F.lit("none"))


def merge_batch(spark: SparkSession, store: str, batch: int, incoming: DataFrame, merge: Merge, schema: StructType = ARTICLES,
                born: str = "first_seen_at", buckets: int = BUCKETS) -> None:
    """Merge `incoming` into the store as batch number `batch`; `merge(stored, incoming)` gives the rows that follow.

    `merge` gets the stored rows of the touched partitions and must keep each of them, by id, and its `born`. Earlier
    partitions that neither this batch nor a replay of it reads are removed.
    """
    incoming = materialize(incoming.select(*schema.fieldNames()), "incoming")
    before = manifest(spark, store, batch - 1)
    arriving = incoming.groupBy("id").agg(F.min(_day(born)).alias("day")).withColumn("in_bucket", _bucket(buckets))
    hit = {r.in_bucket for r in arriving.select("in_bucket").distinct().collect()}  # few numbers
    near = {key: b for key, b in before.items() if key[1] in hit}
    ids = _read(spark, store, near, schema).select("id", "in_day", "in_bucket")
    known = materialize(ids.join(arriving.select("id"), "id", "left_semi"), "known")
    homes = known.select("in_day", "in_bucket").unionByName(  # no more rows than there are partitions and days in the batch
        arriving.join(known.select("id"), "id", "left_anti").select(F.col("day").alias("in_day"), "in_bucket"))
    touched = {(r.in_day, r.in_bucket) for r in homes.distinct().collect()}
    stored = _read(spark, store, {k: b for k, b in before.items() if k in touched}, schema).select(*schema.fieldNames())
    rows = merge(stored, incoming).withColumns({"in_day": _day(born), "in_bucket": _bucket(buckets)})
    data = f"{store}/data/in_batch={batch}"
    rows.repartition("in_day", "in_bucket").write.mode("overwrite").partitionBy("in_day", "in_bucket").parquet(data)
    written = {(day[len("in_day="):], int(bucket[len("in_bucket="):])) for day in _children(spark, data) if day.startswith("in_day=")
               for bucket in _children(spark, f"{data}/{day}") if bucket.startswith("in_bucket=")}
    if not {k for k in touched if k in before} <= written <= touched:
        raise ValueError("a merge may not move or remove stored rows")
    after = before | {key: batch for key in written}
    listed = spark.createDataFrame([(day, bucket, b) for (day, bucket), b in sorted(after.items())], PLACE)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/{batch}")
    _prune(spark, store, before, after, batch)


def _prune(spark: SparkSession, store: str, before: dict, after: dict, batch: int) -> None:
    """Remove what is read by no manifest that still counts: this one, and the one before it, which a replay starts from."""
    used = {(b, key) for kept in (before, after) for key, b in kept.items()}
    for folder in _children(spark, f"{store}/data"):
        number = int(folder[len("in_batch="):]) if folder.startswith("in_batch=") else batch
        for day in _children(spark, f"{store}/data/{folder}") if number < batch else []:
            for bucket in _children(spark, f"{store}/data/{folder}/{day}") if day.startswith("in_day=") else []:
                if bucket.startswith("in_bucket=") and (number, (day[len("in_day="):], int(bucket[len("in_bucket="):]))) not in used:
                    fs, where = _fs(spark, f"{store}/data/{folder}/{day}/{bucket}")
                    fs.delete(where, True)
    for old in [b for b in batches(spark, store) if b < batch][:-1]:
        fs, where = _fs(spark, f"{store}/manifest/{old}")
        fs.delete(where, True)
