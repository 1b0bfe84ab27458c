"""Resumable incremental jobs: file source, stateless step, file sink, resume by checkpoint.

The checkpoint skips input files already processed, so a second run over the same folder adds
nothing; keys already in the sink are skipped by an anti-join in each micro-batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType



def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; under an own folder where that is unset (tests)."""
    import tempfile

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="hopframe-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_stream(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, keys: list[str], step: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_trigger: int = 8) -> None:
    """Processes all input that is there now, then stops.  Interrupted runs go on where they ended."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done = step(batch).dropDuplicates(keys)
        try:
            old = spark.read.parquet(sink).select(*keys)
            done = done.join(old, keys, "left_anti")
        except Exception as e:  # the sink does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        done.write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(spark: SparkSession, source: str, keys: list[str], step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The sink's table after one run in a new folder."""
    folder = shared_folder(spark)
    run_stream(spark, source, spark.read.parquet(source).schema, f"{folder}/sink", f"{folder}/checkpoint", keys, step)
    return spark.read.parquet(f"{folder}/sink")
