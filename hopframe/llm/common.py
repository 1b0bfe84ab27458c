"""Helpers shared by the operators: tables in the shared folder, batch bounds, ids."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: texts per Arrow batch handed to Python; bounds a worker's memory
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on one machine (tests) an own one where it is unset."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or ""
    if not where:
        if sc.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="hopframe-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hopframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])
