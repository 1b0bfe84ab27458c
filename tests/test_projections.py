import pytest
from pyspark.sql import functions as F

from hopframe.operators import projections as P
from hopframe.operators import rewards as W


def test_a_repeat_in_other_words_and_no_supervision(spark):
    """Punctuation and articles make no new query; without facts neither waiting nor evidence counts; roles that did not act get nothing."""
    row = "{t} as traj, {r} as round, '{q}' as query, 'goal' as sub_goal, 3 as n_words, cast(array() as array<int>) as retrieved, cast(array() as array<struct<known:boolean,fact:int>>) as selected, {can} as can_answer, 0.0D as f1, cast(null as string) as parse_error, {need} as required, {roles} as generated_roles"
    every = "array('query_retriever', 'update_evidence', 'answer')"
    parts = [row.format(t=1, r=0, q="capital", can="false", need=0, roles=every), row.format(t=1, r=1, q="The capital?", can="true", need=0, roles=every), row.format(t=2, r=0, q="the", can="false", need=1, roles="array('query_retriever')")]
    turns = spark.sql(" union all ".join(f"select {p}" for p in parts))
    got = {(r["traj"], r["round"], r["role"]): round(r["reward"], 6) for r in W.action_rewards(turns).collect()}
    assert got[1, 0, "query_retriever"] == pytest.approx(0.25 + 0.25 + 0.15 - 0.1) and got[1, 1, "query_retriever"] == pytest.approx(0.25 + 0.25 - 0.5 - 0.1)
    assert got[1, 0, "answer"] == 0 and got[1, 1, "answer"] == 0
    assert {k[2] for k in got if k[0] == 2} == {"query_retriever"} and got[2, 0, "query_retriever"] == pytest.approx(0.25 + 0.25 - 0.5)
    penalties = {r["traj"]: (r["query_cost"], r["query_repeat"]) for r in W.query_reward(turns).collect()}
    assert penalties[1] == pytest.approx((-0.2, -0.2)) and penalties[2] == (0, 0)


def test_facts_match_by_id_then_title_then_text(spark):
    facts = spark.sql("select 1 as traj, array(named_struct('doc_id', 'D1', 'title', 'X', 'text', 'alpha beta'), named_struct('doc_id', '', 'title', 'The Title', 'text', 'gamma'), named_struct('doc_id', ' ', 'title', '', 'text', '')) as facts").select("traj", P.fact_items(F.col("facts")).alias("items"))
    assert facts.select(F.size("items")).first()[0] == 2
    kind = "traj int, n int, passage struct<doc_id:string,title:string,text:string>"
    rows = [(1, 0, ("d1", "Z", "")), (1, 1, ("D9", "X", "alpha beta")), (1, 2, (None, "title", "zzz")), (1, 3, (None, None, "say alpha beta now")), (1, 4, (None, None, "gamma")), (1, 5, (None, None, "")), (2, 6, ("D1", None, None))]
    got = {r["n"]: r["fact"] for r in P.matched_facts(spark.createDataFrame(rows, kind), facts).collect()}
    assert got == {0: 0, 1: None, 2: 1, 3: 0, 4: 1, 5: None, 6: None}


def test_rejoin_keeps_order_and_size(spark):
    asked = spark.createDataFrame([(0, "a"), (1, "b")], "index int, query string")
    good = spark.createDataFrame([(1, "B"), (0, "A")], "index int, result string")
    assert sorted(map(tuple, P.rejoined(asked, good).collect())) == [(0, "a", "A"), (1, "b", "B")]
    with pytest.raises(ValueError):
        P.rejoined(asked, good.limit(1))
    with pytest.raises(ValueError):
        P.rejoined(asked, spark.createDataFrame([(1, "B"), (1, "A")], "index int, result string"))


def test_cache_counts_across_batches(spark):
    """Two new queries, then none: three hits and two misses in all."""
    batch = lambda *qs: spark.createDataFrame(list(enumerate(qs)), "index int, query string").withColumn("dataset", F.lit("d"))
    retrieve = lambda q: q.withColumn("result", F.upper("key"))
    first, cache = P.cached_retrieval(batch(" Q1 ", "q1", "q2"), None, retrieve)
    second, _ = P.cached_retrieval(batch("q1", "q2"), cache, retrieve)
    both = first.unionByName(second)
    assert both.where("hit").count() == 3 and both.where("not hit").count() == 2
    assert [r["result"] for r in first.orderBy("index").collect()] == ["Q1", "Q1", "Q2"]


def test_context_is_completed(spark):
    none = "cast(array() as array<string>)"
    context = spark.sql(f"select 1 as qid, 0 as pos, 'A' as title, cast(null as array<string>) as sentences union all select 1, 1, 'B', array('own') union all select 2, 0, 'Z', {none}")
    facts = spark.sql("select 1 as qid, 0 as ord, 'C' as title union all select 1, 1, 'A' union all select 1, 2, 'C' union all select 1, 3, 'missing'")
    external = spark.sql(f"select 'A' as title, array('a1', 'a2') as sentences union all select 'C', array('c') union all select 'B', array('other') union all select 'E', {none}")
    got = {(r["qid"], r["pos"]): (r["title"], r["sentences"]) for r in P.context_backfilled(context, facts, external).collect()}
    assert got == {(1, 0): ("A", ["a1", "a2"]), (1, 1): ("B", ["own"]), (1, 2): ("C", ["c"]), (2, 0): ("Z", [])}
