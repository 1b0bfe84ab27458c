"""Mixing sources to target weights by entropy balancing.

Token targets of the sources come from weights with a cap.  Document rates r in [0, 2] lie as
close as they can (in relative entropy) to one copy each while every source's rated tokens
meet its target: the dual of that convex problem has one multiplier for each source, and the
rates are exponential tilts of the document's size, r / (2 - r) = exp(a * size / mean size).
Newton steps on the multipliers are aggregations over the histogram of (source, size).
Rates are then rounded to whole copies by spreading the rounding error: within a stratum of
a source, documents from large to small take the copies that bring the sum nearest to the
rated one; where the sum is off by more than a whole document, that document takes one copy
more or less than its rate says.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import prepare, written
from hopframe.llm.textcore import blocks

MOST_COPIES = 2.0
STRATUM_ROWS = 20_000
NEWTON_STEPS = 60
TOLERANCE = 1e-6
#: multipliers stay in this range; at its ends rates are 0 or 2 to double precision
STEEPEST = 60.0


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``size``: the words of the whole text (null: 0)."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in batches:
            sizes = [np.diff(b.words) for b in blocks(batch.column(text_col))]
            counts = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), counts], names=[*rest, "size"])

    schema = docs.select(*rest).withColumn("size", F.lit(0).cast("long")).schema
    return docs.mapInArrow(run, schema)


def default_weights(names: list[str | None]) -> list[float]:
    """5, 2, 1 repeating over the sources in code point order, null last."""
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]


def capped_targets(totals: list[float], weights: list[float], size: float, cap: float = MOST_COPIES) -> list[float]:
    """Shares of ``size`` by weight, none above ``cap`` times its total; the excess is shared anew by weight."""
    target = [0.0] * len(totals)
    full: set[int] = set()
    while True:
        open_ = [i for i in range(len(totals)) if i not in full]
        left = size - sum(cap * totals[i] for i in full)
        weight = sum(weights[i] for i in open_)
        for i in open_:
            target[i] = max(left, 0.0) * weights[i] / weight if weight else 0.0
        over = [i for i in open_ if target[i] > cap * totals[i]]
        if not over:
            break
        full |= set(over)
        for i in over:
            target[i] = cap * totals[i]
    return target


def _tilt(a, x):
    return MOST_COPIES / (F.lit(1.0) + F.exp(-a * x))


def balance(histogram: DataFrame, sources: DataFrame, newton_steps: int = NEWTON_STEPS) -> DataFrame:
    """``sources`` with the multiplier ``a`` of each: distributed Newton steps with bisection as guard.

    ``histogram(source_no, size, n)`` holds the sizes of documents; ``sources(source_no, total,
    mean, target)`` is one row for each source.  Each step aggregates rated tokens and their
    derivative; a step that would leave the bracket halves it.
    """
    spark = sources.sparkSession
    # a source at its cap takes all its documents twice, which is the end of the range and needs no step
    state = {r["source_no"]: {"a": 0.0, "lo": -STEEPEST, "hi": STEEPEST, "target": r["target"], "mean": r["mean"], "total": r["total"], "open": r["target"] < MOST_COPIES * r["total"]} for r in sources.collect()}
    exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")  # noqa: E731  the order of partial sums doesn't matter
    for _ in range(newton_steps):
        left = [(k, s["a"], s["mean"]) for k, s in state.items() if s["open"]]
        if not left:
            break
        now = F.broadcast(spark.createDataFrame(left, "source_no int, a double, mean double"))
        x = F.col("size") / F.col("mean")
        rate = _tilt(F.col("a"), x)
        sums = histogram.join(now, "source_no").groupBy("source_no").agg(exact(rate * F.col("size") * F.col("n")).alias("g"), exact(rate * (1 - rate / MOST_COPIES) * x * F.col("size") * F.col("n")).alias("h"))
        for r in sums.collect():
            s = state[r["source_no"]]
            miss = r["g"] - s["target"]
            if abs(miss) <= TOLERANCE * max(s["target"], 1.0) or s["hi"] - s["lo"] < 1e-12:
                s["open"] = False
                continue
            s["hi" if miss > 0 else "lo"] = s["a"]
            step = s["a"] - miss / r["h"] if r["h"] > 0 else math.inf
            s["a"] = step if s["lo"] < step < s["hi"] else (s["lo"] + s["hi"]) / 2
    return spark.createDataFrame([(k, s["a"]) for k, s in state.items()], "source_no int, a double")


def _round_stratum(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows with whole copies whose running sum follows the rated sum."""
    pdf = pdf.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], na_position="last")
    sizes, rates = pdf["size"].to_numpy(np.float64), pdf["rate"].to_numpy(np.float64)
    copies = np.zeros(len(pdf), np.int64)
    off = 0.0
    for i in range(len(pdf)):
        low = math.floor(rates[i])
        part, size = rates[i] - low, sizes[i]
        take = part > 0 and off + (1 - part) * size <= part * size - off
        off += ((1 - part) if take else -part) * size
        copies[i] = low + take
        # what a large document left over, and the rates of small ones can't take back
        while size and abs(off) > size and 0 <= copies[i] - math.copysign(1, off) <= MOST_COPIES:
            copies[i] -= int(math.copysign(1, off))
            off -= math.copysign(size, off)
    return pdf[["source_no", "doc_id", "size", "row"]].assign(copies=copies)


def mix_sources(docs: DataFrame, share: float = 1.5, weights: Callable[[list], list[float]] = default_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, source)``, one row for each row of ``docs``.

    The sources are few (a table of them is on the driver).  A null source is a source of its
    own, last in order.  Null and empty texts have size 0 and take nothing.  Rows that share
    an id count each.  Nothing is random: reruns agree.
    """
    return _mixed(docs, share, weights, id_col, text_col, source_col).drop("row")


def _mixed(docs: DataFrame, share: float, weights: Callable[[list], list[float]], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows of :func:`mix_sources` with ``row``, the number among those of equal source, id and size."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sized = written(word_counts(named), "sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = [float(r["total"]) for r in rows]
    targets = capped_targets(totals, weights([r["source"] for r in rows]), share * sum(totals))
    table = [(i, r["source"], int(r["total"]), max(r["total"] / r["n"], 1.0), t, max(1, math.ceil(r["n"] / STRATUM_ROWS))) for i, (r, t) in enumerate(zip(rows, targets))]
    sources = spark.createDataFrame(table, "source_no int, source string, total long, mean double, target double, strata int")
    numbered = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    histogram = written(numbered.where("size > 0").groupBy("source_no", "size").agg(F.count("*").alias("n")), "histogram")
    tilts = balance(histogram, sources)
    full = F.col("target") >= MOST_COPIES * F.col("total")
    rate = F.when(full, MOST_COPIES).otherwise(_tilt(F.col("a"), F.col("size") / F.col("mean")))
    rated = numbered.join(F.broadcast(tilts), "source_no").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    # equal rows are told apart by a number among their likes, which also deals them to strata
    parts = rated.groupBy("source_no", "strata", "doc_id", "size", "rate").agg(F.count("*").alias("likes"))
    listed = parts.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("likes"))))
    listed = listed.withColumn("stratum", F.pmod(F.xxhash64("doc_id", "size", "row"), F.col("strata")).cast("int"))
    rounded = listed.select("source_no", "stratum", "doc_id", "size", "rate", "row").groupBy("source_no", "stratum").applyInPandas(_round_stratum, "source_no int, doc_id long, size long, row long, copies long")
    info = sources.select("source_no", F.col("source"), F.col("total").alias("source_size"), "target")
    result = rounded.join(F.broadcast(info), "source_no")
    return result.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "row")


def repeat_to_mix(docs: DataFrame, share: float = 1.5, weights: Callable[[list], list[float]] = default_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as :func:`mix_sources` takes it, all columns as they are.

    Each row has copies of its own: rows of equal source, id (or none) and size are numbered
    in the order of their texts' hashes.
    """
    prepare(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sized = word_counts(packed.withColumn("_order", F.xxhash64("text"))).where("size > 0").withColumnRenamed("size", "_size")
    numbered = sized.withColumn("_no", F.row_number().over(Window.partitionBy("_source", "_id", "_size").orderBy("_order")).cast("long"))
    taken = _mixed(docs, share, weights, id_col, text_col, source_col).where("copies > 0").select("source", "doc_id", "size", "row", F.col("copies").cast("int").alias("_copies"))
    same = F.col("_source").eqNullSafe(F.col("source")) & F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_size") == F.col("size")) & (F.col("_no") == F.col("row"))
    joined = numbered.join(taken, same)
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
