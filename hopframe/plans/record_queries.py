"""Record shapes over the driver's tables.  Events stand for samples, turns and results; a user is a trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions import text as X
from hopframe.operators import projections as P
from hopframe.operators import rewards as R
from hopframe.plans.registry import query, table

_NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_BARE = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[.,:?-]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_E = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
x AS (SELECT event_id AS qid, user_id, k, value, event_type AS dataset, 'train' AS split, CASE WHEN k % 9 = 0 THEN NULL ELSE 'What of ' || k || '?' END AS question, CASE WHEN k % 4 > 0 THEN 'the ' || event_type END AS answer,
  CASE WHEN k % 2 = 0 THEN 'bridge' END AS question_type, k % 3 + 1 AS hop_count FROM e)"""


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def examples(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    fact = lambda d, t, x: F.struct(d.alias("doc_id"), t.alias("title"), F.lit(0).alias("sent_id"), x.alias("text"), F.when(k % 2 == 0, "model").alias("source"))
    facts = F.array(fact(F.concat(F.lit(" D-"), k % 10), F.lit(""), F.lit(None).cast("string")), fact(F.lit(None).cast("string"), F.lit("The T"), F.col("event_type")), fact(F.lit(" "), F.lit(""), F.lit("")))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("qid"), "user_id", "k", "value", F.col("event_type").alias("dataset"), F.lit("train").alias("split"), F.when(k % 9 != 0, F.concat(F.lit("What of "), k, F.lit("?"))).alias("question"), F.when(k % 4 > 0, F.concat(F.lit("the "), "event_type")).alias("answer"),
        F.when(k % 2 == 0, "bridge").alias("question_type"), (k % 3 + 1).alias("hop_count"), F.when(k % 5 > 0, facts).alias("supporting_facts"), F.when(k % 3 == 0, F.array(F.lit("alias"))).alias("answer_aliases"),
    )


@query(f"WITH {_E} SELECT qid, coalesce(question, '') AS question, answer, split, dataset, question_type, hop_count FROM x", "F12")
def question_projection(spark, sf_dir):
    return P.questions(examples(spark, sf_dir))


@query(f"WITH {_E} SELECT qid, dataset, question, question_type, hop_count FROM x", "F16")
def compact_example(spark, sf_dir):
    return P.compact_examples(examples(spark, sf_dir))


@query(f"WITH {_E} SELECT answer, CASE WHEN k % 3 = 0 THEN 'alias' ELSE '' END AS aliases, CASE WHEN k % 5 > 0 THEN 3 ELSE 0 END AS n_facts FROM x", "F20")
def reward_sample(spark, sf_dir):
    return P.reward_samples(examples(spark, sf_dir)).select("answer", F.array_join("answer_aliases", "|").alias("aliases"), F.coalesce(F.size("supporting_facts"), F.lit(0)).alias("n_facts"))


@query(f"WITH {_E} SELECT qid, CASE WHEN k % 5 = 0 THEN '' WHEN k % 2 = 0 THEN 'model|model|model' ELSE 'gold|gold|gold' END AS sources FROM x", "F26")
def fact_defaults(spark, sf_dir):
    return examples(spark, sf_dir).select("qid", F.array_join(P.with_defaults(F.col("supporting_facts"))["source"], "|").alias("sources"))


@query(f"WITH {_E} SELECT qid, CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS required, CASE WHEN k % 5 = 0 THEN '' ELSE 'D-' || (k % 10) || '|The T|' || dataset END AS texts, CASE WHEN k % 5 = 0 THEN '' ELSE '1,2' END AS sizes FROM x", "F27 R8")
def fact_items(spark, sf_dir):
    f = F.col("supporting_facts")
    groups = P.fact_groups(f)
    return examples(spark, sf_dir).select("qid", F.size(P.fact_items(f)).alias("required"), F.array_join(P.fact_texts(f), "|").alias("texts"), F.array_join(F.transform(groups, lambda g: F.size(g).cast("string")), ",").alias("sizes"))


def _evidence():
    k = F.col("k")
    one = lambda i: F.struct(F.lit(i).alias("passage_id"), F.concat(F.lit("T"), k % 7).alias("title"), F.concat("event_type", F.lit(" text")).alias("text"), F.col("value").alias("score"))
    return F.when(k % 4 == 0, F.array(one(0), one(2))).when(k % 4 == 1, F.array(one(1)))


@query(f"WITH {_E} SELECT qid, CASE k % 4 WHEN 0 THEN '[{{\"passage_id\":9}},{{\"passage_id\":0,\"title\":\"T' || (k % 7) || '\",\"text\":\"' || dataset || ' text\"}},{{\"passage_id\":2,\"title\":\"T' || (k % 7) || '\",\"text\":\"' || dataset || ' text\"}}]' WHEN 1 THEN '[{{\"passage_id\":9}},{{\"passage_id\":1,\"title\":\"T' || (k % 7) || '\",\"text\":\"' || dataset || ' text\"}}]' ELSE '[{{\"passage_id\":9}}]' END AS state FROM x", "F17 F29")
def state_evidence(spark, sf_dir):
    old = F.array(F.struct(F.lit(9).alias("passage_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text")))
    return events(spark, sf_dir).select(F.col("event_id").alias("qid"), F.to_json(P.state_with(old, _evidence())).alias("state"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN '{"selected_passage_ids":[1,2],"rationale":null}' WHEN 'view' THEN '{"can_answer":true,"answer":"x"}' ELSE '{}' END AS masked FROM events""", "F18")
def masked_update(spark, sf_dir):
    body = F.when(F.col("event_type") == "click", '{"score": 3, "rationale": null, "selected_passage_ids": [1, 2]}').when(F.col("event_type") == "view", '{"answer": "x", "gold": "y", "can_answer": true}').otherwise('{"gold": 1}')
    return events(spark, sf_dir).select("event_id", P.masked_update(body).alias("masked"))


@query(f"WITH {_E} SELECT qid, CASE WHEN k % 2 = 0 THEN 'goal' WHEN k % 3 = 0 THEN 'sub ' || dataset WHEN k % 5 > 0 THEN 'ask' ELSE '' END AS sub_goal, CASE WHEN k % 5 > 0 THEN 'ask' WHEN k % 3 = 0 THEN 'sub ' || dataset ELSE '' END AS query FROM x", "F29")
def query_target(spark, sf_dir):
    k = F.col("k")
    t = P.query_target(F.when(k % 2 == 0, "goal"), F.when(k % 3 == 0, F.concat(F.lit("sub "), "event_type")), F.when(k % 5 > 0, "ask").otherwise(""))
    return events(spark, sf_dir).select(F.col("event_id").alias("qid"), t["sub_goal"].alias("sub_goal"), t["query"].alias("query"))


@query(f"""WITH {_E} SELECT qid, CASE WHEN k % 3 = 0 THEN 'new goal' WHEN k % 3 = 1 THEN 'plan' ELSE 'find ' || k END AS sub_goal, CASE WHEN k % 3 = 0 THEN 'new ' || k ELSE 'find ' || k END AS query,
CASE WHEN k % 2 = 0 THEN '1,0' ELSE CASE WHEN k % 3 = 2 THEN '2' ELSE '2,0' END END AS ids FROM x""", "L6 L7 F28")
def older_shapes(spark, sf_dir):
    k = F.col("k")
    two = "struct<sub_goal:string,query:string>"
    new = F.when(k % 3 == 0, F.struct(F.lit(" new goal").alias("sub_goal"), F.concat(F.lit("new "), k).alias("query"))).cast(two)
    plan = F.struct(F.when(k % 3 == 1, "plan").otherwise("").alias("sub_goal"), F.lit(None).cast("string").alias("sub_query"))
    old = F.struct(F.concat(F.lit("find "), k, F.lit(" ")).alias("query"))
    q = P.compatible_query(new, plan, old)
    pick = lambda p, r: F.struct(F.lit(p).cast("string").alias("passage_id"), F.lit(r).cast("string").alias("rank"))
    chosen = F.array(pick(None, 2), pick(None, 2), F.when(k % 3 == 2, pick("x", 1)).otherwise(pick(0, 1)), pick(7, 0))
    ids = P.compatible_ids(F.when(k % 2 == 0, F.array(*map(F.lit, ("1", "zz", "0", "1", "-1", "9")))), chosen, F.lit(3))
    return events(spark, sf_dir).select(F.col("event_id").alias("qid"), q["sub_goal"].alias("sub_goal"), q["query"].alias("query"), F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query(f"WITH {_E} SELECT qid, 'q ' || k AS query, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS top_k FROM x", "F28")
def retrieval_action(spark, sf_dir):
    a = P.retrieval_action(F.concat(F.lit(" q "), "k", F.lit("\n")), _evidence())
    return events(spark, sf_dir).select(F.col("event_id").alias("qid"), a["query"].alias("query"), a["top_k"].alias("top_k"))


def _message():
    k = F.col("k")
    return F.when(k % 5 == 0, "Embedding index NOT FOUND").when(k % 5 == 1, "vLLM request timed out").when(k % 5 == 2, "bad value").when(k % 5 == 3, "no such file")


@query(f"""WITH {_E} SELECT dataset, qid, question, 'rollout' AS stage, CASE k % 3 WHEN 0 THEN 'RuntimeError' WHEN 1 THEN 'ValueError' ELSE 'FileNotFoundError' END AS error_type, CASE k % 5 WHEN 0 THEN 'Embedding index NOT FOUND' WHEN 1 THEN 'vLLM request timed out' WHEN 2 THEN 'bad value' WHEN 3 THEN 'no such file' END AS message,
k % 3 = 2 OR (k % 3 = 0 AND k % 5 IN (0, 1)) AS fatal FROM x""", "F22 F30")
def error_records(spark, sf_dir):
    k = F.col("k")
    failed = examples(spark, sf_dir).withColumn("error_type", F.when(k % 3 == 0, "RuntimeError").when(k % 3 == 1, "ValueError").otherwise("FileNotFoundError")).withColumn("message", _message())
    return P.error_records(failed, "rollout").withColumn("fatal", P.infrastructure_error(F.col("error_type"), F.col("message")))


@query(f"""WITH {_E} SELECT qid, dataset, question, CASE WHEN k % 7 = 0 OR k % 4 = 0 THEN '' ELSE dataset || '!' END AS pred_answer, answer AS gold_answer, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 2 = 0 THEN 2 ELSE 0 END AS n_turns, CASE WHEN k % 7 = 0 THEN 0 ELSE k % 3 END AS retrieval_count, CASE WHEN k % 7 = 0 THEN 'boom' END AS error FROM x""", "F21")
def prediction_records(spark, sf_dir):
    k = F.col("k")
    none = F.lit(None).cast("array<string>")
    r = examples(spark, sf_dir).withColumn("error", F.when(k % 7 == 0, "boom")).withColumn("final_answer", F.when(k % 4 > 0, F.concat("dataset", F.lit("!")))).withColumn("trajectory", F.when(k % 2 == 0, F.array(F.lit("t"), F.lit("u")))).withColumn("parse_errors", none).withColumn("retrieval_count", F.when(k % 3 > 0, k % 3))
    return P.predictions(r).select("qid", "dataset", "question", "pred_answer", "gold_answer", F.size("trajectory").alias("n_turns"), "retrieval_count", "error")


@query("SELECT event_id, event_id % 3 AS endpoint FROM events", "F31")
def endpoint_rotation(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", P.endpoint(F.col("event_id"), 3).alias("endpoint"))


@query("""SELECT event_id, '{"a\\"b":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '","z":' || CASE WHEN event_type = 'view' THEN 'null' ELSE '"1"' END || '}' AS body FROM events""", "F23 F24")
def sorted_json(spark, sf_dir):
    pairs = F.create_map(F.lit("z"), F.when(F.col("event_type") != "view", "1"), F.lit("k"), F.col("k").cast("string"), F.lit('a"b'), F.col("event_type"))
    return events(spark, sf_dir).select("event_id", P.sorted_json(pairs).alias("body"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, round(value, 6) AS value, CASE WHEN event_type = 'click' THEN NULL ELSE user_id END AS user_id FROM events", "P35 F24")
def json_round_trip(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("user_id", F.when(F.col("event_type") != "click", F.col("user_id")))
    body = F.to_json(F.struct("event_id", "event_type", "k", "value", "user_id"))
    back = F.from_json(body, "event_id long, event_type string, k int, value double, user_id long")
    return e.select(back.alias("b")).select("b.event_id", "b.event_type", "b.k", F.round("b.value", 6).alias("value"), "b.user_id")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN TRUE WHEN 'click' THEN FALSE WHEN 'error' THEN TRUE WHEN 'signup' THEN FALSE ELSE TRUE END AS flag FROM events", "P29")
def lenient_bool(spark, sf_dir):
    said = F.when(F.col("event_type") == "view", " Y ").when(F.col("event_type") == "click", "No").when(F.col("event_type") == "error", "maybe").when(F.col("event_type") == "signup", "")
    return events(spark, sf_dir).select("event_id", P.lenient_bool(said, True).alias("flag"))


@query("""WITH p AS (SELECT conv_id AS qid, turn AS pos, 'T' || (turn % 4) AS title, CASE WHEN length(text) % 3 = 0 THEN '' ELSE substr(text, 1, 9) END AS s FROM conversations),
ext AS (SELECT 'T' || n AS title, 'ext ' || n AS s FROM range(0, 7) r(n) WHERE n <> 5),
f AS (SELECT DISTINCT conv_id AS qid, n AS ord, 'T' || ((conv_id + n * 2) % 8) AS title FROM conversations, range(0, 3) r(n)),
a AS (SELECT f.qid, f.title, min(ord) AS ord FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.qid = f.qid AND p.title = f.title) GROUP BY ALL),
n AS (SELECT qid, max(pos) + 1 AS n FROM p GROUP BY qid)
SELECT p.qid, p.pos, p.title, CASE WHEN p.s <> '' THEN p.s ELSE coalesce(ext.s, '') END AS sentences FROM p LEFT JOIN ext USING (title)
UNION ALL SELECT a.qid, n.n + row_number() OVER (PARTITION BY a.qid ORDER BY a.ord) - 1, a.title, ext.s FROM a JOIN ext USING (title) JOIN n USING (qid)""", "J4 J3")
def context_backfill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    context = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), F.concat(F.lit("T"), F.col("turn") % 4).alias("title"), F.when(F.length("text") % 3 == 0, none).otherwise(F.array(F.substring("text", 1, 9))).alias("sentences"))
    external = spark.range(7).where("id <> 5").select(F.concat(F.lit("T"), "id").alias("title"), F.array(F.concat(F.lit("ext "), "id")).alias("sentences"))
    facts = c.select(F.col("conv_id").alias("qid")).distinct().withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("title", F.concat(F.lit("T"), (F.col("qid") + F.col("ord") * 2) % 8))
    return P.context_backfilled(context, facts, external).select("qid", "pos", "title", F.array_join("sentences", "|").alias("sentences"))


@query("SELECT event_id, string_agg(i::VARCHAR, ',' ORDER BY pos) AS ids FROM (SELECT event_id, unnest([user_id, user_id + 1, event_id]) AS i, unnest([0, 1, 2]) AS pos FROM events) WHERE i IN (SELECT doc_id FROM labels) GROUP BY event_id", "J6")
def known_context_ids(spark, sf_dir):
    held = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i")).distinct()
    ids = events(spark, sf_dir).select("event_id", F.posexplode(F.array("user_id", F.col("user_id") + 1, "event_id")).alias("pos", "i")).join(held, "i", "left_semi")
    return ids.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i"))), lambda s: s["i"].cast("string")), ",").alias("ids"))


# Passages and facts of trajectories: a user's events are its turns, each of which observes three passages.
_PASSAGES = """t AS (SELECT user_id AS traj, event_id AS round, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
seen AS (SELECT traj, round, k, i AS passage_id, CASE WHEN (k + i) % 4 = 0 THEN '' ELSE 'd-' || ((k + i) % 10) END AS doc_id, CASE WHEN (k + i) % 3 = 0 THEN '' ELSE 'The T' || ((k + i) % 6) END AS title, 'a ' || event_type || ' text ' || ((k + i) % 5) AS text FROM t, range(0, 3) r(i)),
fact AS (SELECT traj, 0 AS fi, 'D ' || (traj % 10) AS doc_id, '' AS title, '' AS text FROM (SELECT DISTINCT traj FROM t) UNION ALL SELECT DISTINCT traj, 1, '', 'T' || (traj % 6), 'click text' FROM t UNION ALL SELECT DISTINCT traj, 2, '', '', 'view text ' || (traj % 5) FROM t)"""
_FACT = f"""n AS (SELECT s.*, f.fi, {_BARE.format('s.doc_id')} AS pd, {_BARE.format('f.doc_id')} AS fd, {_BARE.format('s.title')} AS pt, {_BARE.format('f.title')} AS ft, {_BARE.format("s.doc_id || ' ' || s.title || ' ' || s.text")} AS px, {_BARE.format('f.text')} AS fx FROM pick s JOIN fact f USING (traj)),
hit AS (SELECT traj, round, pos, min(CASE WHEN CASE WHEN pd <> '' AND fd <> '' THEN pd = fd WHEN pt <> '' AND ft <> '' THEN pt = ft ELSE fx <> '' AND px <> '' AND (contains(px, fx) OR contains(fx, px)) END THEN fi END) AS fact FROM n GROUP BY ALL)"""
_PICK = "pick AS (SELECT seen.*, c.pos FROM seen JOIN (SELECT traj, round, unnest([0, k % 4, 7]) AS passage_id, unnest([0, 1, 2]) AS pos FROM t WHERE k % 5 > 0) c USING (traj, round, passage_id))"


def _trajectories(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("k")
    one = lambda i: F.struct(F.lit(i).alias("passage_id"), F.when((k + i) % 4 == 0, "").otherwise(F.concat(F.lit("d-"), (k + i) % 10)).alias("doc_id"), F.when((k + i) % 3 == 0, "").otherwise(F.concat(F.lit("The T"), (k + i) % 6)).alias("title"), F.concat(F.lit("a "), "event_type", F.lit(" text "), (k + i) % 5).alias("text"))
    e = events(spark, sf_dir).select(F.col("user_id").alias("traj"), F.col("event_id").alias("round"), "event_type", "k", F.array(*map(one, range(3))).alias("passages"), F.when(k % 5 > 0, F.array(F.lit(0), k % 4, F.lit(7))).alias("ids"))
    t = F.col("traj")
    fact = lambda d, n, x: F.struct(d.alias("doc_id"), n.alias("title"), x.alias("text"))
    none = F.lit("")
    facts = F.array(fact(F.concat(F.lit("D "), t % 10), none, none), fact(none, F.concat(F.lit("T"), t % 6), F.lit("click text")), fact(none, none, F.concat(F.lit("view text "), t % 5)))
    return e, e.select("traj").distinct().withColumn("items", P.fact_items(facts))


@query(f"WITH {_PASSAGES}, {_PICK} SELECT traj, round, pos, doc_id, title, text FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY traj, round ORDER BY pos) - 1 AS pos) FROM pick)", "J15 J16")
def selected_by_id(spark, sf_dir):
    turns, _ = _trajectories(spark, sf_dir)
    none = F.lit(None).cast(turns.schema["passages"].dataType)
    return P.selected_passages(turns.withColumn("evidence", none)).select("traj", "round", "pos", "passage.doc_id", "passage.title", "passage.text")


@query(f"WITH {_PASSAGES}, pick AS (SELECT *, passage_id AS pos FROM seen), {_FACT} SELECT * FROM hit", "J17 F27")
def matched_facts(spark, sf_dir):
    turns, facts = _trajectories(spark, sf_dir)
    seen = turns.select("traj", "round", F.posexplode("passages").alias("pos", "passage"))
    return P.matched_facts(seen, facts).select("traj", "round", "pos", "fact")


@query(f"WITH {_PASSAGES}, {_PICK}, {_FACT}, c AS (SELECT traj, count(DISTINCT fact) AS covered FROM hit GROUP BY traj) SELECT traj, coalesce(covered, 0) AS covered, 3 AS required, round(coalesce(covered, 0) / 3.0, 6)::DOUBLE AS coverage FROM (SELECT DISTINCT traj FROM t) LEFT JOIN c USING (traj)", "A12 J16 J17 F27")
def support_coverage(spark, sf_dir):
    """Coverage from passages and facts as they are, selection included."""
    turns, facts = _trajectories(spark, sf_dir)
    none = F.lit(None).cast(turns.schema["passages"].dataType)
    hits = P.matched_facts(P.selected_passages(turns.withColumn("evidence", none)), facts)
    n = facts.select("traj", F.size("items").alias("required")).join(hits.groupBy("traj").agg(F.count_distinct("fact").alias("covered")), "traj", "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return n.select("traj", "covered", "required", F.round(F.col("covered") / F.col("required"), 6).alias("coverage"))


@query("""WITH t AS (SELECT user_id AS traj, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id FROM events) SELECT event_id, traj, CASE WHEN k % 2 = 0 THEN 'answer' ELSE 'query_retriever' END AS role, k AS round, CASE WHEN k < 20 THEN k / 4.0 ELSE 0.0 END AS local FROM t""", "J18 F30")
def action_credit(spark, sf_dir):
    k = F.col("k")
    acts = events(spark, sf_dir).select("event_id", F.col("user_id").alias("traj"), F.when(k % 2 == 0, "answer").otherwise("query_retriever").alias("role"), k.alias("round"))
    given = acts.where("round < 20").select("traj", "role", "round").distinct().withColumn("reward", F.col("round") / 4.0)
    return R.with_credit(acts, given).select("event_id", "traj", "role", "round", "local")


@query("SELECT event_id AS index, event_type AS query, upper(event_type) || user_id AS result FROM events", "J20 G12 S22")
def ordered_rejoin(spark, sf_dir):
    asked = events(spark, sf_dir).select(F.col("event_id").alias("index"), F.col("event_type").alias("query"), "user_id")
    answers = asked.repartition(5, "query").select("index", F.concat(F.upper("query"), "user_id").alias("result"))
    return P.rejoined(asked.drop("user_id"), answers)


@query("SELECT DISTINCT CAST(CASE WHEN user_id % 3 > 0 THEN user_id ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS VARCHAR) AS qid FROM events", "J22")
def existing_qids(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.when(F.col("user_id") % 3 > 0, F.col("user_id").cast("string")).alias("qid"), F.struct(F.col("k").cast("string").alias("qid")).alias("metadata"))
    return rows.select(F.coalesce("qid", "metadata.qid").alias("qid")).where("qid is not null").distinct()


_CACHE = f"""r AS (SELECT event_id AS index, event_type AS dataset, CASE WHEN user_id % 2 = 0 THEN ' Ask  ' ELSE 'ASK ' END || (user_id % 40) AS query FROM events), kd AS (SELECT *, lower({_NORM.format('query')}) AS key FROM r),
h AS (SELECT *, key IN ('ask 1', 'ask 2') OR row_number() OVER (PARTITION BY dataset, key ORDER BY index) > 1 AS hit FROM kd)"""


def _cached(spark, sf_dir) -> DataFrame:
    asked = events(spark, sf_dir).select(F.col("event_id").alias("index"), F.col("event_type").alias("dataset"), F.concat(F.when(F.col("user_id") % 2 == 0, " Ask  ").otherwise("ASK "), F.col("user_id") % 40).alias("query"))
    warm = asked.select("dataset").distinct().withColumn("key", F.explode(F.array(F.lit("ask 1"), F.lit("ask 2")))).withColumn("result", F.concat(F.lit("R:"), "key"))
    return P.cached_retrieval(asked, warm, lambda q: q.withColumn("result", F.concat(F.lit("R:"), "key")))[0]


@query(f"WITH {_CACHE} SELECT index, dataset, query, 'R:' || key AS result, hit FROM h", "G14 J19 J20 P31")
def cached_retrieval(spark, sf_dir):
    return _cached(spark, sf_dir)


@query(f"WITH {_CACHE} SELECT dataset, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS cache_misses FROM h GROUP BY dataset", "A24")
def cache_counts(spark, sf_dir):
    return P.cache_counts(_cached(spark, sf_dir))


@query("SELECT DISTINCT 'h' || user_id AS hash_id, CASE WHEN user_id IN (SELECT doc_id FROM labels) THEN 'passage ' ELSE 'entity ' END || user_id AS content FROM events UNION SELECT 'h' || doc_id, 'passage ' || doc_id FROM labels", "U7")
def node_union(spark, sf_dir):
    name = lambda c, what: (F.concat(F.lit("h"), c).alias("hash_id"), F.concat(F.lit(f"{what} "), c).alias("content"))
    return P.node_union(events(spark, sf_dir).select(*name("user_id", "entity")).distinct(), table(spark, sf_dir, "labels").select(*name("doc_id", "passage")).distinct())


@query("SELECT event_id, array_to_string(list_filter([user_id % 4, 5], lambda d: d IN (0, 5)), ',') AS shared FROM events", "U5")
def device_overlap(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.array_join(F.array_intersect(F.array(F.col("user_id") % 4, F.lit(5).cast("long")), F.array(F.lit(0).cast("long"), F.lit(5).cast("long"))).cast("array<string>"), ",").alias("shared"))


@query(f"WITH {_E} SELECT qid, CASE WHEN k % 6 = 0 THEN FALSE WHEN k % 6 = 1 THEN k % 4 < 2 ELSE k % 4 < 2 AND (dataset = 'click' OR k % 6 = 3) END AS supported FROM x", "P16")
def answer_support_v0(spark, sf_dir):
    k = F.col("k")
    answer = F.when(k % 6 == 1, "Yes").when(k % 6 == 3, " TEXT").when(k % 6 > 0, "click  text")
    return events(spark, sf_dir).select(F.col("event_id").alias("qid"), P.answer_supported_v0(answer, F.coalesce(_evidence()["text"], F.array().cast("array<string>"))).alias("supported"))


@query(f"""WITH {_E}, v AS (SELECT *, CASE WHEN k % 6 = 0 THEN '' WHEN k % 6 = 1 THEN 'Yes' WHEN k % 6 = 2 THEN 'no' WHEN k % 6 = 3 THEN 't' || (k % 7) || ' click' ELSE 'view TEXT' END AS ans, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM x),
s AS (SELECT *, k % 8 > 0 AND CASE WHEN ans = '' THEN FALSE WHEN ans = 'Yes' THEN n > 0 AND dataset = 'click' WHEN ans = 'no' THEN n >= 2 ELSE n > 0 AND contains('t' || (k % 7) || ' ' || dataset || ' text', lower(ans)) END AS ok FROM v)
SELECT qid, ok AS can_answer, CASE WHEN ok OR k % 8 = 0 THEN ans END AS answer, CASE WHEN ok OR k % 8 = 0 THEN 'because' ELSE 'Current selected evidence does not support a final answer.' END AS rationale FROM s""", "P17 L8")
def demoted_answers(spark, sf_dir):
    k = F.col("k")
    answer = F.when(k % 6 == 0, "").when(k % 6 == 1, "Yes").when(k % 6 == 2, "no").when(k % 6 == 3, F.concat(F.lit("t"), k % 7, F.lit(" click"))).otherwise("view TEXT")
    question = F.when(k % 6 == 1, "is it Text of Click then").otherwise("is it so")
    t = events(spark, sf_dir).withColumn("question", question).withColumn("can_answer", k % 8 > 0).withColumn("answer", answer).withColumn("rationale", F.lit("because")).withColumn("evidence", F.coalesce(_evidence(), F.array().cast("array<struct<passage_id:int,title:string,text:string,score:double>>")))
    return P.demoted(t).select(F.col("event_id").alias("qid"), "can_answer", "answer", "rationale")


@query("""WITH j AS (SELECT event_type AS dataset, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT dataset, count(*) AS n, round(avg(CASE WHEN k % 7 <> 1 AND k % 3 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS judge, round(avg((k % 2)::DOUBLE), 6) AS contain, round(avg((k % 5 = 0)::INTEGER::DOUBLE), 6) AS exact, round(avg(k / 100.0::DOUBLE), 6) AS f1, count(*) FILTER (k % 7 = 1) AS judge_errors FROM j GROUP BY dataset""", "E1 E2 E3 E9")
def judged_summary(spark, sf_dir):
    k = F.col("k")
    response = F.when(k % 3 == 0, " Correct\n").when(k % 3 == 1, "incorrect").otherwise("It is correct")
    rows = events(spark, sf_dir).select(F.col("event_type").alias("dataset"), response.alias("response"), F.when(k % 7 == 1, "timeout").alias("judge_error"), (k % 2).cast("double").alias("contain"), (k % 5 == 0).cast("double").alias("exact"), (k / 100.0).alias("f1"))
    return P.judged(rows, "dataset").select("dataset", "n", *[F.round(c, 6).alias(c) for c in ("judge", "contain", "exact", "f1")], "judge_errors")


@query("""WITH t AS (SELECT user_id AS grp, event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), b AS (SELECT grp, event_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, event_id) AS r FROM t) WHERE r = 1)
SELECT grp, count(*) AS n, round(avg(value), 4) AS reward_mean, round(min(value), 4) AS reward_min, round(max(value), 4) AS reward_max, round(stddev_pop(value), 4) AS reward_std, any_value(best) AS best, count(*) FILTER (k = 0) AS parse_errors, sum(k)::BIGINT AS tokens, round(sum(value * k) / greatest(sum(k), 1), 4) AS loss FROM t JOIN b USING (grp) GROUP BY grp""", "E5 A17 A21 A23")
def train_metrics(spark, sf_dir):
    t = events(spark, sf_dir).withColumnRenamed("user_id", "grp")
    v = F.col("value")
    r4 = lambda c, n: F.round(c, 4).alias(n)
    return t.groupBy("grp").agg(F.count("*").alias("n"), r4(F.avg(v), "reward_mean"), r4(F.min(v), "reward_min"), r4(F.max(v), "reward_max"), r4(F.stddev_pop(v), "reward_std"), F.max_by("event_id", F.struct(v, -F.col("event_id"))).alias("best"), F.count_if(F.col("k") == 0).alias("parse_errors"), F.sum("k").alias("tokens"), r4(F.sum(v * F.col("k")) / F.greatest(F.sum("k"), F.lit(1)), "loss"))


@query("""WITH t AS (SELECT user_id AS grp, event_id, event_type, value FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, event_id) AS r FROM t)
SELECT grp, max(event_id) FILTER (r = 1) AS best, max(event_type) FILTER (r = 1) AS best_answer, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS "group" FROM b GROUP BY grp""", "E6 A23")
def rollout_payload(spark, sf_dir):
    t = events(spark, sf_dir).withColumnRenamed("user_id", "grp")
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("value", -F.col("event_id")))
    rows = t.groupBy("grp").agg(best.alias("b"), F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("g"))
    return rows.select("grp", F.col("b.event_id").alias("best"), F.col("b.event_type").alias("best_answer"), F.array_join(F.transform("g", lambda x: F.concat_ws(":", x["event_id"].cast("string"), x["event_type"])), ",").alias("group"))


@query("""WITH l AS (SELECT user_id AS run, event_id AS step, CAST(json_extract_string(props, '$.k') AS INTEGER) + (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER * 3 AS seen, CASE WHEN event_type <> 'view' THEN round(value, 3) END AS loss FROM events),
w AS (SELECT * FROM l WHERE loss IS NOT NULL), p AS (SELECT *, coalesce(max(seen) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM w),
x AS (SELECT run, loss, unnest(range(last, seen)) AS z FROM p WHERE seen > last) SELECT run, z // 25 + 1 AS epoch, z % 25 + 1 AS sample, 25 AS sample_total, loss FROM x""", "E8 E11 W17")
def logged_samples(spark, sf_dir):
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    logs = events(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), (F.col("k") + order * 3).cast("int").alias("seen"), F.when(F.col("event_type") != "view", F.round("value", 3)).alias("loss"))
    return P.logged_samples(logs, 25)


@query(f"SELECT conv_id, turn, role, regexp_replace(substr({_NORM.format('text')}, 1, 40), '[0-9]', '#', 'g') AS preview, count(*) OVER (PARTITION BY role) AS n_role FROM conversations", "E10")
def check_preview(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    counts = F.broadcast(c.groupBy("role").agg(F.count("*").alias("n_role")))  # a row for each of three roles
    return c.join(counts, "role").select("conv_id", "turn", "role", P.masked_preview(F.col("text")).alias("preview"), "n_role")


@query(f"""WITH {_E} SELECT qid, CASE WHEN k % 10 = 0 THEN 'failed' WHEN k % 10 < 4 THEN 'filtered' ELSE 'written' END AS status, CASE WHEN k % 10 = 0 THEN 'plan:ValueError' WHEN k % 10 = 1 THEN 'forbidden_training_label_text' WHEN k % 10 = 2 THEN 'state_leakage' WHEN k % 10 = 3 THEN 'unseen_intermediate_query' END AS reason FROM x""", "L4 P27")
def teacher_status(spark, sf_dir):
    k = F.col("k")
    errors = F.when(k % 10 == 2, F.array(F.lit("state.evidence has future items"))).when(k % 10 == 3, F.array(F.lit("unseen intermediate term"))).otherwise(F.array().cast("array<string>"))
    said = F.when(k % 10 == 1, "this is the Gold answer").otherwise("plain")
    s = events(spark, sf_dir).select(F.col("event_id").alias("qid"), F.when(k % 10 == 0, "ValueError").alias("error_type"), F.lit("plan").alias("stage"), errors.alias("errors"), X.leaks(said).alias("leaks"))
    return P.teacher_status(s).select("qid", "status", "reason")


@query("""WITH t AS (SELECT user_id AS qid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS round, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), m AS (SELECT qid, min(round) FILTER (k % 5 = 0) AS stop, max(round) AS last FROM t GROUP BY qid),
g AS (SELECT t.qid, string_agg(t.round || ':' || event_type, ',' ORDER BY t.round) AS trajectory, max(CASE WHEN t.round = coalesce(stop, last) AND k % 5 = 0 THEN event_type END) AS final_answer FROM t JOIN m USING (qid) WHERE t.round <= coalesce(stop, last) GROUP BY t.qid)
SELECT l.doc_id AS qid, 'd' AS dataset, 'gold ' || l.doc_id AS gold_answer, coalesce(trajectory, '') AS trajectory, final_answer FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN g ON g.qid = l.doc_id""", "L10 W9")
def assembled_samples(spark, sf_dir):
    k = F.col("k")
    t = events(spark, sf_dir).select(F.col("user_id").alias("qid"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("round"), F.col("event_type").alias("query"), (k % 5 == 0).alias("can_answer"), F.when(k % 5 == 0, F.col("event_type")).alias("answer"))
    none = F.lit(None).cast("string")
    ex = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid")).distinct().select("qid", F.lit("d").alias("dataset"), none.alias("split"), none.alias("question"), F.concat(F.lit("gold "), "qid").alias("answer"), none.alias("question_type"), F.lit(1).alias("hop_count"))
    return P.assembled(ex, t).select("qid", "dataset", "gold_answer", F.array_join(F.transform("trajectory", lambda x: F.concat_ws(":", x["round"].cast("string"), x["query"])), ",").alias("trajectory"), "final_answer")


@query("SELECT dataset, ord, n_records FROM (SELECT event_type AS dataset, event_id AS ord, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS n_records FROM events) WHERE dataset IN ('view', 'click', 'error') AND n_records > 0 ORDER BY CASE dataset WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, ord LIMIT 250", "L13 K5 U2")
def first_training_samples(spark, sf_dir):
    """The limit is the operator's own: the first samples of the files in their order."""
    s = events(spark, sf_dir).select(F.col("event_type").alias("dataset"), F.col("event_id").alias("ord"), (F.col("k") % 4).alias("n_records"))
    return P.first_samples(s, ["view", "click", "error"], 250)


@query("SELECT user_id AS traj, event_id AS round, event_type AS evidence, 0 AS n_roles, FALSE AS can_answer, CASE WHEN event_type = 'error' THEN 'answer' END AS parse_error_role FROM events", "L16 L1")
def blank_turns(spark, sf_dir):
    s = events(spark, sf_dir).select(F.col("user_id").alias("traj"), F.col("event_id").alias("round"), F.array("event_type").alias("evidence"))
    failures = events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("traj"), F.col("event_id").alias("round"), F.lit("answer").alias("role"))
    t = P.with_parse_failure(P.blank_turns(s), failures)
    return t.select("traj", "round", F.array_join("evidence", "|").alias("evidence"), F.size("generated_roles").alias("n_roles"), "can_answer", "parse_error_role")
