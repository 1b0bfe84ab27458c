"""Queries over trajectories.  Conversations stand for them: a user turn asks, the next answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions import text as X
from hopframe.operators import loop as L
from hopframe.plans.registry import query, table

_NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
TURNS = f"""
t0 AS (SELECT conv_id AS traj, turn, role, {_NORM.format('text')} AS body, lead({_NORM.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
turns AS (SELECT traj, row_number() OVER (PARTITION BY traj ORDER BY turn) - 1 AS round, body AS query, coalesce(reply, '') AS reply, length(coalesce(reply, '')) % 3 = 0 AS can_answer FROM t0 WHERE role = 'user')"""
_SENT = "list_filter(list_transform(string_split(regexp_replace(reply, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def turns(spark, sf_dir) -> DataFrame:
    body = X.normalize_text("text")
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj"), "turn", "role", body.alias("body"), F.lead(body).over(Window.partitionBy("conv_id").orderBy("turn")).alias("reply")).where("role = 'user'")
    reply = F.coalesce("reply", F.lit(""))
    return t.select("traj", (F.row_number().over(Window.partitionBy("traj").orderBy("turn")) - 1).cast("long").alias("round"), F.col("body").alias("query"), reply.alias("reply"), (F.length(reply) % 3 == 0).alias("can_answer"))


def _full(spark, sf_dir) -> DataFrame:
    """Turns with observed sentences, chosen ids, evidence so far and answers."""
    t = turns(spark, sf_dir).withColumn("observed", F.when(F.col("reply") != "", X.sentences("reply")).otherwise(F.array().cast("array<string>")))
    t = t.withColumn("ids", F.when(F.length("query") % 4 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))).withColumn("picked", F.array_compact(F.transform("ids", lambda i: F.get("observed", i))))
    t = L.cumulative(t, "picked", "evidence").withColumn("before", F.slice("evidence", 1, F.size("evidence") - F.size("picked")))
    t = t.withColumn("top_k", F.size("observed")).withColumn("passage_ids", F.transform("observed", lambda p, i: i)).withColumn("retrieval_count", F.col("round")).withColumn("history", F.col("round"))
    w = Window.partitionBy("traj")
    answer = F.when(F.col("can_answer"), F.coalesce(F.get("evidence", F.lit(0)), F.lit("")))
    return t.withColumn("answer", answer).withColumn("question", F.first("query").over(w.orderBy("round"))).withColumn("last", F.col("round") == F.max("round").over(w))


_FULL = f"""{TURNS}, o AS (SELECT *, CASE WHEN reply <> '' THEN {_SENT} ELSE [] END AS observed, CASE WHEN length(query) % 4 = 0 THEN [0, 2] ELSE [0] END AS ids FROM turns),
p AS (SELECT *, list_filter([observed[1], CASE WHEN len(ids) = 2 THEN observed[3] END], lambda x: x IS NOT NULL) AS picked FROM o),
ev AS (SELECT *, flatten(list(picked) OVER (PARTITION BY traj ORDER BY round)) AS evidence FROM p)"""


@query()
def parse_actions(spark, sf_dir):
    """Action texts of every event parsed and checked; JSON types are those of variants, so tests compare with Python."""
    k = F.get_json_object("props", "$.k").cast("int")
    role = F.element_at(F.array(F.lit("query_retriever"), F.lit("update_evidence"), F.lit("answer")), (k % 3 + 1).cast("int"))
    bodies = {
        0: F.when(k % 2 == 0, F.concat(F.lit('{"sub_goal":"find","query":"'), "event_type", F.lit('"}'))).otherwise(F.lit('{"sub_goal":1,"query":"x"}')),
        1: F.when(k % 4 == 0, F.lit('{"selected_passage_ids":[true],"rationale":"r"}')).when(k % 4 == 1, F.lit('{"selected_passage_ids":["0"],"rationale":"r"}')).when(k % 4 == 2, F.lit('{"selected_passage_ids":[],"rationale":"r"}')).otherwise(F.concat(F.lit('{"selected_passage_ids":['), k, F.lit('],"rationale":"r"}'))),
        2: F.when(k % 4 == 0, F.lit('{"can_answer":1,"answer":"a","rationale":"r"}')).when(k % 4 == 1, F.lit('{"can_answer":"TRUE","answer":"a","rationale":"r"}')).when(k % 4 == 2, F.lit('{"can_answer":false,"answer":null,"rationale":"r"}')).otherwise(F.lit('{"can_answer":true,"answer":null,"rationale":"r"}')),
    }
    tags = list(L.TAGS.values())
    body = F.coalesce(*[F.when(k % 3 == i, F.concat(F.lit(f"thought <{tags[i]}> "), b, F.lit(f" </{tags[i]}>"))) for i, b in bodies.items()])
    rows = table(spark, sf_dir, "events").select("event_id", k.alias("k"), role.alias("role"), body.alias("text"))
    return L.parse_actions(rows).select("event_id", "role", "error", "query", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "can_answer")


@query(f"WITH {TURNS} SELECT traj, round, query FROM (SELECT *, coalesce(sum(can_answer::INT) OVER (PARTITION BY traj ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM turns) WHERE b = 0")
def truncate_trajectory(spark, sf_dir):
    return L.truncated(turns(spark, sf_dir)).select("traj", "round", "query")


@query(f"WITH {TURNS} SELECT traj, arg_max(reply, round) AS final_reply, max(round) AS last_round FROM turns GROUP BY traj")
def last_turn(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("traj").agg(F.max_by("reply", "round").alias("final_reply"), F.max("round").alias("last_round"))


@query(f"WITH {_FULL} SELECT traj, round, len(evidence) AS n_evidence, md5(array_to_string(evidence, '|')) AS digest FROM ev")
def cumulative_evidence(spark, sf_dir):
    return _full(spark, sf_dir).select("traj", "round", F.size("evidence").cast("long").alias("n_evidence"), F.md5(F.array_join("evidence", "|")).alias("digest"))


@query(f"""WITH {_FULL}, x AS (SELECT traj, round, unnest(observed) AS body, unnest(range(0, len(observed))) AS passage_id FROM o) SELECT traj, round, passage_id, '' AS title, body FROM x""")
def observation_normalize(spark, sf_dir):
    t = _full(spark, sf_dir).select("traj", "round", F.explode(L.observations(F.col("observed"))).alias("p"))
    return t.select("traj", "round", F.col("p.passage_id").cast("long").alias("passage_id"), "p.title", F.col("p.text").alias("body"))


@query(f"WITH {_FULL} SELECT traj, round, len(picked) AS n_selected, coalesce(picked[1], '') AS first_text FROM p")
def select_passages(spark, sf_dir):
    t = _full(spark, sf_dir)
    chosen = L.select_passages(F.col("ids"), L.observations(F.col("observed")))
    return t.select("traj", "round", F.size(chosen).cast("long").alias("n_selected"), F.coalesce(F.get(chosen, F.lit(0))["text"], F.lit("")).alias("first_text"))


@query()
def validate_trajectory(spark, sf_dir):
    """Broken rules of every turn; phrases follow word boundaries that DuckDB has not."""
    return L.validation_errors(_full(spark, sf_dir)).select("traj", "round", F.array_join("errors", "; ").alias("errors"))


@query()
def filter_reasons(spark, sf_dir):
    t = L.validation_errors(_full(spark, sf_dir)).withColumn("half", F.col("traj") % 2)
    return L.reason_histogram(t, "half")


@query()
def unseen_terms(spark, sf_dir):
    t = _full(spark, sf_dir)
    allowed = F.concat_ws(" ", "question", F.array_join("evidence", " "))
    return t.select("traj", "round", F.coalesce(X.has_unseen_term("query", allowed), F.lit(False)).alias("unseen"))


@query(f"WITH {_FULL}, f AS (SELECT traj, round, can_answer, replace(lower(coalesce(CASE WHEN can_answer THEN coalesce(evidence[1], '') END, '')), 'ß', 'ss') AS a, replace(lower(array_to_string(evidence, ' ')), 'ß', 'ss') AS e FROM ev) SELECT traj, round, can_answer AND a <> '' AND contains(e, a) AS supported FROM f")
def evidence_support(spark, sf_dir):
    t = _full(spark, sf_dir)
    return t.select("traj", "round", L.supported(F.col("question"), F.coalesce("answer", F.lit("")), F.col("evidence"), F.col("can_answer")).alias("supported"))


@query(f"""WITH {TURNS}, s AS (SELECT traj, CASE WHEN max(round) = 0 THEN 'skipped' WHEN bool_or(can_answer) THEN 'written' WHEN count(*) > 2 THEN 'filtered' ELSE 'failed' END AS status FROM turns GROUP BY traj)
SELECT traj % 4 AS grp, count(*) AS seen, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER (status = 'failed') AS failed, greatest(10 - count(*) FILTER (status = 'written'), 0) AS remaining FROM s GROUP BY 1""")
def funnel_stats(spark, sf_dir):
    s = turns(spark, sf_dir).groupBy("traj").agg(F.when(F.max("round") == 0, "skipped").when(F.max("can_answer"), "written").when(F.count("*") > 2, "filtered").otherwise("failed").alias("status"))
    return L.funnel(s.withColumn("grp", F.col("traj") % 4), "grp", 10)


@query(f"""WITH {_FULL} SELECT traj, round, 0 AS ord, 'query_retriever' AS role, length(query) > 0 AS ok FROM ev WHERE query <> '' UNION ALL SELECT traj, round, 1, 'update_evidence', true FROM ev UNION ALL SELECT traj, round, 2, 'answer', true FROM ev""")
def sft_records(spark, sf_dir):
    r = L.training_records(_full(spark, sf_dir))
    return r.select("traj", "round", "ord", "role", F.startswith("target", F.lit("<")).alias("ok"))


@query("SELECT conv_id, turn, contains(lower(text), 'gold') OR contains(lower(text), 'supervised trajectory') OR contains(lower(text), 'completed from') AS leaked FROM conversations")
def leak_check(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.leaks("text").alias("leaked"))


@query()
def dry_run_loop(spark, sf_dir):
    """Benchmark items go through the loop with the deterministic policy; the corpus rows that hold an item answer it."""
    from hopframe.operators.matching import contained_pairs

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    key = X.normalize_key("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("body"))
    found = contained_pairs(items.select(F.col("qid").alias("item_id"), key.alias("fact")), docs).groupBy(F.col("item_id").alias("qid")).agg(F.array_sort(F.collect_list("doc_id")).alias("hits"))
    samples = items.select("qid", X.first_words("text", 8).alias("question"), X.capitalized_phrases("text").alias("titles"), (F.col("qid") % 3 + 1).cast("int").alias("hop_count"), F.get(X.sentences("text"), F.lit(0)).alias("gold"))

    def retrieve(rows: DataFrame) -> DataFrame:
        return rows.join(found, "qid", "left").withColumn("observed", F.when(F.col("query") != "", F.transform(F.coalesce("hits", F.array().cast("array<bigint>")), lambda d: d.cast("string"))).otherwise(F.array().cast("array<string>"))).drop("hits")

    t = L.run_loop(samples, retrieve)
    return t.select("traj", "round", "query", F.array_join("evidence", ",").alias("evidence"), "can_answer", "answer")


@query("SELECT user_id, island, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, island")
def consecutive_runs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("new", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return e.groupBy("user_id", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS action_no FROM events")
def action_ordinals(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", "event_type", (F.row_number().over(w) - 1).cast("long").alias("action_no"))
