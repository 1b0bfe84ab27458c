"""Packing into optimal length buckets.

Lengths are cut into pieces of at most ``max_len`` tokens, so the global histogram has at
most ``max_len`` bins.  Dynamic programming over it chooses the bucket boundaries that
minimise padding (each piece is padded to its bucket's boundary).  Inside a bucket, strata
of a bounded number of pieces are dealt into batches of at most ``budget`` padded tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import prepare, written
from hopframe.llm.mixing import word_counts

STRATUM_ROWS = 20_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most ``k`` boundaries (the largest length among them) with the least padding.

    cost(i, j) = counts in (i, j] times length j, less their tokens.  The cost satisfies the
    quadrangle inequality, so each row of the table is filled by divide and conquer.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(lengths)
    if n == 0:
        return []
    k = min(k, n)
    number = np.concatenate([[0], np.cumsum(counts)])
    best = np.concatenate([[0], number[1:] * lengths])  # one bucket for the first j lengths; tokens are constant
    best[0] = 0
    cuts = np.zeros((k, n + 1), np.int64)
    for b in range(1, k):
        now = np.full(n + 1, np.inf)
        todo = [(b + 1, n, b, n - 1)]
        while todo:
            lo, hi, a, z = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(z, j - 1) + 1)
            cost = best[i] + (number[j] - number[i]) * lengths[j - 1]
            at = int(np.argmin(cost))
            now[j], cuts[b, j] = cost[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), z)]
        now[: b + 1] = np.concatenate([[0], np.full(b, np.inf)])
        best = now
    found, j = [], n
    for b in range(k - 1, -1, -1):
        found.append(int(lengths[j - 1]))
        j = int(cuts[b, j])
    return sorted(found)


def pack_lengths(sized: DataFrame, max_len: int = 2048, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """``(doc_id, piece, n_pieces, length, bucket, boundary, batch, slot)`` from ``sized(doc_id, size)``.

    A document of size n gives ceil(n / max_len) pieces; one of size 0 or null gives one row of
    length 0 with bucket, boundary, batch and slot null, as it takes no room.  Batches never
    pass the budget unless one piece alone does; each stratum's last batch may be partly
    filled.  Rows that share an id are packed each by itself.
    """
    prepare(sized.sparkSession)
    spark = sized.sparkSession
    size = F.coalesce("size", F.lit(0))
    pieces = F.greatest(F.ceil(size / max_len), F.lit(1)).cast("long")
    cut = sized.select("doc_id", size.alias("size"), pieces.alias("n_pieces"))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)))
    cut = cut.select("doc_id", "piece", "n_pieces", F.least(F.lit(max_len).cast("long"), F.col("size") - F.col("piece") * max_len).alias("length"))
    cut = written(cut, "pieces")
    # at most max_len rows
    histogram = cut.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()
    lengths = np.array([r["length"] for r in histogram], np.int64)
    counts = np.array([r["n"] for r in histogram], np.int64)
    bounds = optimal_boundaries(lengths, counts, buckets)
    rows, low = [], 0
    for b, high in enumerate(bounds):
        n = int(counts[(lengths > low) & (lengths <= high)].sum())
        rows.append((b, low, high, max(1, budget // high), max(1, -(-n // STRATUM_ROWS))))
        low = high
    table = F.broadcast(spark.createDataFrame(rows, "bucket int, low long, boundary long, per_batch long, strata int"))
    which = sum((F.when(F.col("length") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0)) if bounds else F.lit(0)
    filled = cut.where("length > 0").withColumn("bucket", which.cast("int")).join(table, "bucket")
    filled = filled.withColumn("stratum", F.pmod(F.xxhash64("doc_id", "piece"), F.col("strata")).cast("int"))
    w = Window.partitionBy("bucket", "stratum").orderBy("doc_id", "piece", "n_pieces")
    filled = filled.withColumn("at", F.row_number().over(w).cast("long") - 1)
    batch = F.format_string("%d-%d-%d", "bucket", "stratum", F.floor(F.col("at") / F.col("per_batch")))
    placed = filled.select("doc_id", "piece", "n_pieces", "length", "bucket", "boundary", batch.alias("batch"), (F.col("at") % F.col("per_batch")).alias("slot"))
    none = F.lit(None)
    empty = cut.where("length <= 0").select("doc_id", "piece", "n_pieces", "length", none.cast("int").alias("bucket"), none.cast("long").alias("boundary"), none.cast("string").alias("batch"), none.cast("long").alias("slot"))
    return placed.union(empty)


def pack_documents(docs: DataFrame, max_len: int = 2048, buckets: int = 16, budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`pack_lengths` over the words of the whole texts (null: none)."""
    prepare(docs.sparkSession)
    return pack_lengths(word_counts(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))), max_len, buckets, budget)
