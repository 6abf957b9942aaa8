"""Which sets share at least so many tokens: a join on rare tokens, and counting in tiles for common ones.

Tokens of a set come from rare to common, in one order for all sets of a window. Two sets that share t tokens have the first of
these with t - 1 tokens or more behind it in both. Where few sets hold that one it is a join key, and its pairs are candidates.
Where many do, the rest is at least as common; so such sets are told by their crowded tokens alone, which are counted exactly for
all pairs of a tile of bounded size by a product of matrices of noughts and ones. Rows written are never more than tokens.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIGHT = 16  # candidates a set may cost in a key; tokens of more sets are crowded
PART_ROWS = 1024  # probe rows of a key in one part of a join
TILE_ROWS = 1024  # sets on either side of a tile
TILE_TOKENS = 4096  # tokens of a tile counted at once


def overlap_keys(nodes: DataFrame, legs: list[tuple[str, str, int]], light: int = LIGHT) -> DataFrame:
    """`nodes` (window, id, ..) with `join_keys`, an array of (key, parts), and `crowded`, an array of (leg, shared, tokens).

    `legs` names array columns, ordered from rare to common and without repeats, with the tokens that two sets must
    share: any two nodes of a window that do so in some leg have a key in common, or so many of a leg's crowded tokens. Keys of
    a single node are left out. `parts` is the number of parts that the probe side of a key is dealt to (`few_pairs`).

    A token is crowded if the pairs of its sets are more than `light` for each; where one shared token is enough, none is, as
    all its pairs are true. Keys are numbers; two that fall together only add candidates.
    """
    lists = None
    for name, column, shared in legs:
        leg = nodes.select("window", "id", F.lit(name).alias("leg"), F.lit(shared).alias("shared"), F.col(column).alias("list"))
        lists = leg if lists is None else lists.unionByName(leg)
    rows = lists.select("window", "id", "leg", "shared", F.size("list").alias("size"), F.posexplode("list").alias("at", "token"))
    sizes = rows.groupBy("window", "leg", "token").agg(F.count("*").alias("n")).filter("n > 1")
    many = (F.col("shared") > 1) & (F.col("n") > 2 * light + 1)
    first = F.col("at") <= F.col("size") - F.col("shared")
    key = F.struct(F.xxhash64("leg", "token").alias("key"), F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    keys = rows.join(sizes, ["window", "leg", "token"]).groupBy("window", "id").agg(
        F.collect_set(F.when(~many & first, key)).alias("join_keys"),
        F.collect_list(F.when(many, F.struct("leg", "token"))).alias("found"))

    def of_leg(name):
        return F.transform(F.filter("found", lambda c: c["leg"] == F.lit(name)), lambda c: c["token"])

    crowded = F.filter(F.array(*[F.struct(F.lit(name).alias("leg"), F.lit(shared).alias("shared"), of_leg(name).alias("tokens"))
                                 for name, _, shared in legs]), lambda c: F.size(c["tokens"]) >= c["shared"])
    keys = keys.withColumn("crowded", crowded).drop("found")
    out = nodes.join(keys, ["window", "id"], "left")
    for name in ("join_keys", "crowded"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(keys.schema[name].dataType)))
    return out


def few_pairs(probe: DataFrame, index: DataFrame) -> DataFrame:
    """(window, later, later_rank, earlier): pairs of probe and earlier index rows with a key in common, each once.

    The probe rows of a key are dealt to its parts, and each part has all of its index rows, so that a key which a third of
    all rows have is not one task's work.
    """
    def keyed(df):
        return df.select("window", "id", "rank", F.explode("join_keys").alias("k")).select(
            "window", "id", "rank", "k.key", "k.parts")
    p = keyed(probe).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    i = keyed(index).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    return p.withColumnsRenamed({"id": "later", "rank": "later_rank"}).join(
        i.withColumnsRenamed({"id": "earlier", "rank": "earlier_rank"}), ["window", "key", "part"]).filter(
        "earlier_rank < later_rank").select("window", "later", "later_rank", "earlier").distinct()


def _counted(key: tuple, probe: pd.DataFrame, index: pd.DataFrame, one: bool) -> pd.DataFrame:
    """The pairs of a tile that share enough; with `one` only one of each probe row."""
    sides, rows, ends = (probe, index), [], []
    for side in sides:
        lengths = side["tokens"].map(len).to_numpy(dtype=np.int64)
        rows.append(np.repeat(np.arange(len(side)), lengths))
        ends.append(int(lengths.sum()))
    codes, names = pd.factorize(np.concatenate([t for side in sides for t in side["tokens"]]) if sum(ends) else np.array([], object))
    codes = [codes[:ends[0]], codes[ends[0]:]]
    counts = np.zeros((len(probe), len(index)), np.float32)
    for low in range(0, len(names), TILE_TOKENS):
        held = []
        for side, row, code in zip(sides, rows, codes):
            here = (code >= low) & (code < low + TILE_TOKENS)
            ones = np.zeros((len(side), min(TILE_TOKENS, len(names) - low)), np.float32)
            ones[row[here], code[here] - low] = 1
            held.append(ones)
        counts += held[0] @ held[1].T
    ranks, before = probe["rank"].to_numpy(), index["rank"].to_numpy()
    near = before[None, :] < ranks[:, None]
    if len(probe):
        near &= counts >= probe["shared"].iloc[0]
    if one:
        later = np.flatnonzero(near.any(axis=1))
        earlier = near[later].argmax(axis=1) if len(later) else later
    else:
        later, earlier = np.nonzero(near)
    window = pd.Series([key[0]] * len(later), dtype=object)
    return pd.DataFrame({"window": window, "later": probe["id"].to_numpy()[later], "later_rank": ranks[later],
                         "earlier": index["id"].to_numpy()[earlier]})


def crowded_pairs(probe: DataFrame, index: DataFrame, one: bool = False) -> DataFrame:
    """(window, later, later_rank, earlier): pairs of probe and earlier index rows that share enough crowded tokens of a leg.

    These pairs are true ones, and may come once a leg. With `one` a probe row comes with at least one of its earlier rows,
    but not with all: at most one a tile.
    """
    def keyed(df):
        return df.select("window", "id", "rank", F.explode("crowded").alias("c")).select("window", "id", "rank", "c.*")

    def chunks(df, name):
        return df.groupBy("window", "leg").agg(F.ceil(F.count("*") / TILE_ROWS).alias(name))

    p, i = keyed(probe), keyed(index)
    sizes = chunks(p, "p_chunks").join(chunks(i, "i_chunks"), ["window", "leg"])

    def tiled(df, own, other):
        return (df.join(sizes, ["window", "leg"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}_chunks")))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_chunks") - 1)))
                .select(*[F.col(c).alias(c) for c in ("window", "leg", "p", "i", "id", "rank", "shared", "tokens")])
                .groupBy("window", "leg", "p", "i"))

    kinds = {f.name: f.dataType.simpleString() for f in probe.schema.fields}

    def counted(key, left, right):
        return _counted(key, left, right, one)

    return tiled(p, "p", "i").cogroup(tiled(i, "i", "p")).applyInPandas(
        counted, f"window {kinds['window']}, later {kinds['id']}, later_rank {kinds['rank']}, earlier {kinds['id']}")


def meet(probe: DataFrame, index: DataFrame, one: bool = False) -> DataFrame:
    """(window, later, later_rank, earlier): each probe row with all earlier index rows that it may share enough with.

    With `one` a probe row comes with one earlier row of a tile at most where these share enough crowded tokens.
    """
    return few_pairs(probe, index).unionByName(crowded_pairs(probe, index, one)).distinct()
