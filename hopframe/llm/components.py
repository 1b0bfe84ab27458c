"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import forget, written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (row["n"], row["h"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node u to the smaller node v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    onto = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return onto.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the smallest node of its component.

    Each round rewires all edges towards local minima and writes the edges to the shared
    folder; it ends when a round changes nothing.  Self-loops keep a lone node in the result.
    """
    edges = edges.where("u is not null and v is not null")
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        old, now = now, written(_small_star(_large_star(now)), "edges")
        forget(old)
        was, seen = seen, _digest(now)
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    both = roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).union(loops)
    return both.groupBy("node").agg(F.min("root").alias("root"))
