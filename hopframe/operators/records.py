"""Training-record pieces: prompts, targets, token arrays, progress, calls to outside models."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pretty_json(x: Column) -> Column:
    """JSON text with two spaces a level, as prompts show states; null stays null."""

    @F.pandas_udf(T.StringType())
    def render(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2))

    return render(x)


def prompt(template: str, **parts: Column) -> Column:
    """A template with {name} places filled by columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def target(tag: str, payload: Column) -> Column:
    """<tag>{json}</tag> with a space after separators outside strings."""

    @F.pandas_udf(T.StringType())
    def spaced(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False))

    return F.concat(F.lit(f"<{tag}>"), spaced(F.to_json(payload)), F.lit(f"</{tag}>"))


def left_padded(ids: Column, n: int, pad: int) -> Column:
    """The last ``n`` ids, padded on the left."""
    kept = F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(kept), F.lit(0))), kept)


def right_padded(ids: Column, n: int, pad: int) -> Column:
    kept = F.slice(ids, 1, n)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(kept), F.lit(0))))


def labels(prompt_ids: Column, target_ids: Column) -> Column:
    """-100 over the prompt, then the target."""
    return F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), target_ids)


def until_end(ids: Column, end: int) -> Column:
    """Ids up to and with the first end mark."""
    at = F.array_position(ids, end)
    return F.when(at > 0, F.slice(ids, 1, at.cast("int"))).otherwise(ids)


def log_softmax_at(logits: Column, at: Column) -> Column:
    """Log probability of the chosen token."""
    top = F.array_max(logits)
    return F.get(logits, at) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def overlength(rows: DataFrame, size: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows that fit and rows that do not."""
    fits = F.coalesce(size <= most, F.lit(False))
    return rows.where(fits), rows.where(~fits)


def progress(spark, samples: int, epochs: int, batch: int) -> DataFrame:
    """(step, epoch, seen): samples seen within the epoch after each step."""
    per_epoch = -(-samples // batch)
    s = spark.range(per_epoch * epochs).withColumnRenamed("id", "step")
    return s.select("step", F.floor(F.col("step") / per_epoch).alias("epoch"), F.least((F.col("step") % per_epoch + 1) * batch, F.lit(samples)).alias("seen"))


def answer_after_marker(x: Column, marker: str = "Answer:") -> Column:
    """Text after the last marker, else all of it, trimmed."""
    return F.trim(F.when(F.contains(x, F.lit(marker)), F.substring_index(x, marker, -1)).otherwise(x))


def call_model(rows: DataFrame, column: str, out: str, make: Callable[[], Callable[[list[str]], list[str]]], tries: int = 3) -> DataFrame:
    """``out``: a model's answers to ``column``, batch by batch on the executors; ``error`` where all tries fail.

    ``make`` builds the client once in each task.  Failures of a batch are tried again; then
    its rows get the error text and a null answer, so one bad batch ends no job.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            failure = None
            for _ in range(tries):
                try:
                    answers = client(batch[column].tolist())
                    if len(answers) != len(batch):
                        raise ValueError(f"{len(answers)} answers to {len(batch)} prompts")
                    yield batch.assign(**{out: answers, "error": None})
                    failure = None
                    break
                except Exception as e:
                    failure = f"{type(e).__name__}: {e}"
            if failure is not None:
                yield batch.assign(**{out: None, "error": failure})

    return rows.mapInPandas(run, schema)
