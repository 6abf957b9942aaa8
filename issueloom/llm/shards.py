"""Shards by jump consistent hashing: a key and the number of shards decide, no table of the ring is kept."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from issueloom.session import materialize

# fixed values of the published generator
FACTOR, MODULUS = 2862933555777941757, 2**64


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a long key among `shards`, and among one more.

    The chain of jumps for one more shard passes through the answer for `shards`, so both come from one walk, and a
    key either stays or moves to the new shard. Negative keys count as unsigned ones; a null key as 0.
    """
    unsigned, modulus = "decimal(20,0)", F.lit(Decimal(MODULUS)).cast("decimal(20,0)")
    start = F.coalesce(key.cast(unsigned), F.lit(0).cast(unsigned))
    start = F.when(start < 0, start + modulus).otherwise(start).cast(unsigned)
    zero = F.lit(0).cast("bigint")
    state = F.struct(start.alias("key"), zero.alias("shard"), zero.alias("grown"), zero.alias("next"))

    def jump(s, _):
        def moved(k):
            high = F.call_function("div", k, F.lit(2**33))
            return F.struct(
                k.alias("key"), F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"),
                s["next"].alias("grown"),
                ((s["next"] + 1) * (F.lit(float(2**31)) / (high + 1).cast("double"))).cast("bigint").alias("next"))
        following = ((s["key"] * F.lit(FACTOR).cast("decimal(19,0)") + 1) % modulus).cast(unsigned)
        return F.when(s["next"] > shards, s).otherwise(F.transform(F.array(following), moved)[0])

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), state, jump,
                       lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `slot`, 0.. in each `group` by `order`, without one task per group.

    Rows are range-partitioned by group and order (a row number splits even equal rows), written, numbered file by
    file, and shifted by the rows of the same group in the files before. Rows equal in all of `order` are taken in
    any order among themselves.
    """
    parts = materialize(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .transform(lambda d: d.repartitionByRange(group, *order, "_tie")), "shard-rows")
    file = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("bigint")
    placed = parts.withColumn("_file", file)
    before = Window.partitionBy(group).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy(group, "_file").count().select(
        group, "_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(group, "_file").orderBy(*order, "_tie")) - 1
    return (placed.withColumn("_local", local).join(shifts, [group, "_file"])
            .withColumn("slot", F.col("_local") + F.col("_shift")).drop("_tie", "_file", "_local", "_shift"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`.

    `size` is the UTF-8 bytes of the text plus 16; a null text has none and the checksum of an empty one. A null key
    is sharded as 0. Repeated rows all stay, each with a slot of its own; an empty table gives no rows; other columns
    are not looked at. Only narrow rows are shuffled, never texts.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), (F.octet_length(data) + 16).cast("bigint").alias("size"),
                       F.crc32(data).alias("text_crc32"), jump_shards(F.col(key), shards).alias("_j"))
    rows = rows.select("doc_id", "size", "text_crc32", "_j.shard", F.col("_j.grown").alias("grown_shard"))
    return numbered(rows, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
