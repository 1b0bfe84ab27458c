"""Names of all queries with their functions and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def query(sql: str | None = None, ids: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the ids of the operators that it exercises."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        OPERATORS[f.__name__] = tuple(ids.split())
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from hopframe.plans import corpus_queries, loop_queries, record_queries, report_queries, retrieval_queries, reward_queries  # noqa: E402, F401
