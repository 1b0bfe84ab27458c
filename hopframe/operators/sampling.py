"""Deterministic sampling, ordering, splits and quotas by hashes of a seed and an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    return df.orderBy(draw(seed, key), key).limit(k)


def per_group_sample(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(draw(seed, key), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def balanced(df: DataFrame, group: str, key: str, total: int, seed: int) -> DataFrame:
    """Round robin over the groups in name order until ``total`` rows are taken."""
    w = Window.partitionBy(group).orderBy(draw(seed, key), key)
    ranked = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= total)
    return ranked.orderBy("turn", group).limit(total)


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Position of every row in the shuffle of an epoch.

    Positions come from a range partitioning by the hash: counts of the ranges before a row's
    range are added to its place inside, so no task sorts all rows.
    """
    hashed = df.withColumn("_h", draw(seed + epoch, key))
    ranges = hashed.withColumn("_r", F.substring("_h", 1, 3))
    before = ranges.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)))
    inside = ranges.withColumn("_i", F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)))
    # at most 4096 ranges
    return inside.join(F.broadcast(before), "_r").withColumn("position", (F.coalesce("_before", F.lit(0)) + F.col("_i") - 1).cast("long")).drop("_h", "_r", "_n", "_before", "_i")


def shard(df: DataFrame, position: str, world: int) -> DataFrame:
    return df.withColumn("rank_no", F.pmod(F.col(position), F.lit(world)).cast("int"))


def train_val(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """``split`` by sample: floor(n * ratio) samples of least draw go to val."""
    ids = df.select(key).distinct()
    placed = epoch_order(ids, key, seed, 0)
    n = ids.agg(F.floor(F.count("*") * F.lit(ratio)).cast("long").alias("_k"))
    split = placed.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("position") < F.col("_k"), "val").otherwise("train"))
    return df.join(split.select(key, "split"), key)


def quota(df: DataFrame, group: str, order: list, k: int, accepted: Column) -> DataFrame:
    """Accepted rows of each group in order until k are reached."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.where(accepted).withColumn("taken", F.row_number().over(w)).where(F.col("taken") <= k)
