"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from hopframe.sources import readers as S

KIND = "qid string, n int"


@pytest.fixture()
def folder(tmp_path):
    lines = ['{"qid":"a","n":1}', "", "  ", "[1]", '{"qid":"b"}']
    (tmp_path / "train.jsonl").write_text("\n".join(lines))
    (tmp_path / "dev.jsonl").write_text('{"qid":"c","n":3}\n')
    (tmp_path / "corpus.jsonl").write_text('{"qid":"x"}\n')
    (tmp_path / "rows.json").write_text(json.dumps([{"qid": "a", "n": 1}, {"qid": "b", "n": 2}]))
    return str(tmp_path)


def test_json(spark, folder):
    read = lambda **k: S.json_lines(spark, f"{folder}/train.jsonl", KIND, **k)
    assert [tuple(r) for r in read(objects_only=True).collect()] == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="not an object"):
        read(strict=True).collect()
    assert S.json_array(spark, f"{folder}/rows.json", KIND).count() == 2


def test_files(spark, folder):
    names = [f.rsplit("/", 1)[1] for f in S.sample_files(spark, folder)]
    assert names == ["dev.jsonl", "train.jsonl"]
    assert S.split_file(spark, folder, "wiki", "validation").endswith("dev.jsonl")
    assert len(S.given_files(spark, folder, ["train.jsonl"])) == 1
    with pytest.raises(FileNotFoundError):
        S.given_files(spark, folder, ["train.jsonl", "none.jsonl"])
    with pytest.raises(FileNotFoundError):
        S.require(spark, folder, ["missing"])
    got = spark.createDataFrame([("/x/hot/train.jsonl",), ("/x/y/wiki.jsonl",)], "p string").select(S.dataset_of(F.col("p")).alias("d")).collect()
    assert [r["d"] for r in got] == ["hot", "wiki"]
    sums = {r["path"].rsplit("/", 1)[1]: r["length"] for r in S.manifest(spark, folder).collect()}
    assert sums["dev.jsonl"] == 18


def test_store_and_graph(spark, tmp_path):
    path = str(tmp_path / "store")
    encode = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("float")))
    rows = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "bb")], "hash_id string, text string")
    assert S.store_upsert(spark, path, rows, encode).count() == 2
    more = spark.createDataFrame([("h2", "bb"), ("h3", "ccc")], "hash_id string, text string")
    store = S.store_upsert(spark, path, more, encode)
    assert store.count() == 3
    ids = spark.createDataFrame([(0, "h3"), (1, "h1")], "ord int, hash_id string")
    assert {r["ord"]: r["embedding"] for r in S.embeddings_of(store, ids).collect()} == {0: [3.0], 1: [1.0]}
    with pytest.raises(Exception, match="unknown id"):
        S.embeddings_of(store, spark.createDataFrame([(0, "zz")], "ord int, hash_id string")).collect()
    nodes, edges = spark.createDataFrame([("n", 1)], "name string, id int"), spark.createDataFrame([(1, 1)], "src int, dst int")
    S.write_graph(nodes, edges, str(tmp_path / "g"))
    assert S.read_graph(spark, str(tmp_path / "g"))[0].first()["name"] == "n"
    with pytest.raises(ValueError):
        S.write_graph(nodes.drop("name"), edges, str(tmp_path / "g2"))
    out = str(tmp_path / "lines")
    S.write_json_lines(nodes, out, by="name")
    S.write_json_lines(nodes, out, append=True, by="name")
    assert spark.read.json(out).count() == 2
    shards = S.parquet_shards(spark, [path], ["hash_id"], limit=2, order=["hash_id"])
    assert shards.columns == ["hash_id", "file_name"] and shards.count() == 2


def test_config():
    assert S.config({"a_b": 1, "c": 2}, {"a-b": 5}, {"c": 3}) == {"a_b": 5, "c": 3}
    with pytest.raises(KeyError):
        S.config({"a": 1}, {"b": 2})
    with pytest.raises(TypeError):
        S.config({}, [1])
