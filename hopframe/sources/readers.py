"""Sources and sinks: JSON lines, JSON arrays, parquet shards, stores, graph tables, assets, configs.

Paths go through Spark's readers, so any store that Spark reaches will do; only small
configuration files are opened on the driver.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPLIT_ALIASES = {"validation": "dev", "val": "dev", "dev": "dev", "train": "train", "test": "test"}
#: file names tried for a split, in order
SPLIT_NAMES = ("{dataset}_{split}.jsonl", "examples.{split}.jsonl", "{split}.jsonl")


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str, objects_only: bool = False, strict: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped.

    ``objects_only`` drops lines that are no objects; ``strict`` makes them an error.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    is_object = F.startswith(F.trim("value"), F.lit("{"))
    if strict:
        lines = lines.withColumn("value", F.when(is_object & F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80)))))
    elif objects_only:
        lines = lines.where(is_object & F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parquet_shards(spark: SparkSession, paths: list[str], columns: list[str] | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Shards as one table with ``file_name``; corrupt files are passed over; a limit takes the first rows in order."""
    df = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "false").parquet(*paths)
    df = df.select(*(columns or df.columns), F.col("_metadata.file_name").alias("file_name"))
    return df.orderBy("file_name", *(order or [])).limit(limit) if limit is not None else df


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> list[str]:
    """Names under a folder in any store Spark reaches, sorted."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(path)
    rule = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + r"\Z")
    found, walk = [], fs.listFiles(root, recursive)
    while walk.hasNext():
        p = walk.next().getPath()
        if rule.match(p.getName()):
            found.append(p.toString())
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sample_files(spark: SparkSession, root: str) -> list[str]:
    """All JSON lines files under a folder but the corpora."""
    return [f for f in list_files(spark, root, "*.jsonl", True) if not f.endswith("/corpus.jsonl")]


def given_files(spark: SparkSession, root: str, names: list[str], expand: bool = True) -> list[str]:
    """Listed files, relative ones under ``root``; folders are expanded; a missing one is an error before any is read."""
    paths = [n if re.match(r"[\w+.-]+:|/", n) else f"{root}/{n}" for n in names]
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(", ".join(missing))
    out: list[str] = []
    for p in paths:
        out += sample_files(spark, p) if expand and not p.endswith(".jsonl") else [p]
    return out


def split_file(spark: SparkSession, root: str, dataset: str, split: str, examples_first: bool = False) -> str:
    """The first of the names a split may have; assets look for the examples first."""
    split = SPLIT_ALIASES.get(split, split)
    names = [SPLIT_NAMES[i] for i in ((1, 0, 2) if examples_first else (0, 1, 2))]
    tried = [f"{root}/{n.format(dataset=dataset, split=split)}" for n in names]
    for path in tried:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(tried))


def store_upsert(spark: SparkSession, path: str, rows: DataFrame, encode) -> DataFrame:
    """Adds ``rows(hash_id, text)`` that the store lacks, encoded, and gives the whole store.

    New rows are appended, so nothing is rewritten; ``encode`` adds the embedding column.
    """
    new = rows.dropDuplicates(["hash_id"])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("hash_id"), "hash_id", "left_anti")
    encode(new).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def embeddings_of(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the store for ``ids(ord, hash_id)``; an unknown id is an error."""
    found = ids.join(store, "hash_id", "left")
    known = F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("unknown id: "), F.col("hash_id"))))
    return found.withColumn("embedding", known)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables; a node table without names is refused."""
    if "name" not in nodes.columns:
        raise ValueError("nodes need names")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_assets(corpus: DataFrame, questions: DataFrame, path: str) -> None:
    """questions, chunks and chunk metadata as JSON lines."""
    questions.write.mode("overwrite").json(f"{path}/questions")
    corpus.select("chunk_id", "chunk").write.mode("overwrite").json(f"{path}/chunks")
    corpus.select("chunk_id", "doc_id", "dataset", "title", F.lit("").alias("source")).write.mode("overwrite").json(f"{path}/chunk_metadata")


def require(spark: SparkSession, root: str, names: list[str]) -> None:
    """Error if one of the index's parts is not there."""
    if missing := [n for n in names if not exists(spark, f"{root}/{n}")]:
        raise FileNotFoundError(f"{root}: {', '.join(missing)}")


def write_json_lines(df: DataFrame, path: str, append: bool = False, by: str | None = None) -> None:
    """JSON lines; overwrite unless told to append; one folder for each value of ``by``."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file, to check downloads by."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def dataset_of(path: Column) -> Column:
    """Dataset name from a file's name, or its folder's where the name is that of a split."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(name.isin(*SPLIT_ALIASES), folder).otherwise(name)


def config(defaults: dict[str, Any], loaded: dict[str, Any] | None = None, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Given values override loaded ones, and those the defaults; dashes are underscores; unknown keys are errors."""
    if loaded is not None and not isinstance(loaded, dict):
        raise TypeError("a configuration must be a mapping")
    fold = lambda d: {k.replace("-", "_"): v for k, v in (d or {}).items()}
    merged = fold(loaded) | {k: v for k, v in fold(given).items() if v is not None}
    if unknown := sorted(set(merged) - set(defaults)):
        raise KeyError(f"unknown settings: {', '.join(unknown)}")
    return defaults | merged


def load_yaml(path: str) -> dict[str, Any]:
    """A small local YAML mapping."""
    import yaml

    with open(path) as f:
        found = yaml.safe_load(f)
    if not isinstance(found or {}, dict):
        raise TypeError(f"{path} holds no mapping")
    return found or {}


def newest_run(spark: SparkSession, root: str, holding: str) -> str | None:
    """The last run folder by name that holds a file."""
    runs = {f.rsplit("/", 2)[-2] for f in list_files(spark, root, holding, True)}
    return max(runs, default=None)
