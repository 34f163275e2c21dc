"""Weighted rendezvous sharding of stable record keys, in DataFrame functions only.

Every record scores every shard from a hash of (key, shard) and goes to the shard with the least ``-ln(u) / weight``. The
choice depends on nothing but the key and the shard list, so a shard that is added takes records only into itself and a
shard that is removed gives up only its own. A record keyed NULL is hashed like any other value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

#: Parts in which each shard is numbered; every part is counted and ranked by itself.
NUMBERING_BITS = 10


def shard_for(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key. ``weights``: a positive weight for each shard number."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("shards need positive weights")
    ids = F.array(*[F.lit(int(s)).cast("long") for s in weights])
    equal = len(set(weights.values())) == 1

    def cost(shard: Column) -> Column:
        # 53 bits of the hash, moved off zero, are uniform in (0, 1)
        u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) * 2.0 ** -53
        return -F.log(u)

    if equal:
        costs = F.transform(ids, lambda s: F.struct(cost(s).alias("cost"), s.alias("shard")))
    else:
        pairs = F.array(*[F.struct(F.lit(int(s)).cast("long").alias("s"), F.lit(float(w)).alias("w"))
                          for s, w in weights.items()])
        costs = F.transform(pairs, lambda p: F.struct((cost(p["s"]) / p["w"]).alias("cost"), p["s"].alias("shard")))
    return F.array_min(costs)["shard"].cast("int")


def numbering_part(key: Column, bits: int = NUMBERING_BITS) -> Column:
    """Which of ``2 ** bits`` parts of its shard a key is numbered in."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(-1).cast("long")), 64 - bits).cast("int")


def with_slots(df: DataFrame, key: str, shard: str, slot: str = "slot", order: tuple[str, ...] = (),
               bits: int = NUMBERING_BITS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard is numbered in parts of its keys: the parts are counted (from the key column alone), the counts are summed
    along each shard, and rows are ranked inside their part. Ties in ``key`` are ordered by ``order``; rows equal in both
    take any of their numbers.
    """
    from pyspark.sql import Window

    part = "__part"
    rows = df.withColumn(part, numbering_part(F.col(key), bits))
    counts = rows.groupBy(F.col(shard).alias("__s"), F.col(part).alias("__p")).agg(F.count("*").alias("__n"))
    along = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__s", "__p", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, part).orderBy(key, *order)
    return (rows.join(starts, (F.col(shard) == F.col("__s")) & (F.col(part) == F.col("__p")))
            .withColumn(slot, (F.col("__start") + F.row_number().over(inside) - 1).cast("long"))
            .drop(part, "__s", "__p", "__start"))


def assign(df: DataFrame, key: str, weights: Mapping[int, float], shard: str = "shard", slot: str = "slot",
           order: tuple[str, ...] = ()) -> DataFrame:
    """All rows of ``df`` with their shard and their slot in it. An empty table gives an empty table."""
    return with_slots(df.withColumn(shard, shard_for(F.col(key), weights)), key, shard, slot, order)
