"""Reward queries.  Events stand for turns: a user's events are a trajectory, their order the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.operators import rewards as R
from hopframe.plans.registry import query, table

TURNS = """
ev AS (SELECT user_id AS traj, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS round, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
turns AS (SELECT traj, round, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN '' ELSE 'The, a?' END ELSE CASE WHEN k % 3 = 0 THEN 'The ' ELSE '' END || event_type || '-' || (k % 10) || CASE WHEN k % 4 = 0 THEN '?' ELSE '' END END AS query, CASE WHEN k % 11 = 0 THEN '' ELSE 'goal' END AS sub_goal, k % 40 AS n_words,
  CASE WHEN k % 5 < 3 THEN k % 5 END AS fact_seen, k % 8 AS n_sel, k, event_type = 'purchase' AS can_answer, least(floor(value) / 100, 1.0) AS f1,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'query_retriever' END AS parse_error, CASE WHEN traj % 6 = 0 THEN 0 ELSE 3 END AS required FROM ev),
sel0 AS (SELECT traj, round, unnest(range(0, n_sel)) AS pos, k FROM turns),
sel AS (SELECT traj, round, pos, pos < 6 AS known, CASE WHEN pos < 6 AND (k + pos) % 9 < 3 THEN (k + pos) % 9 END AS fact FROM sel0),
graded AS (SELECT *, fact IS NOT NULL AND row_number() OVER (PARTITION BY traj, fact ORDER BY round, pos) = 1 AS first FROM sel),
ebr AS (SELECT traj, round, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (known AND fact IS NULL) AS irrelevant, count(*) FILTER (first) AS covers, count(*) FILTER (fact IS NOT NULL AND NOT first) AS again FROM graded GROUP BY traj, round),
nov0 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(query), '[?,-]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS said FROM turns),
nov AS (SELECT *, said <> '' AS says, said <> '' AND row_number() OVER (PARTITION BY traj, said ORDER BY round) = 1 AS novel FROM nov0),
qr AS (SELECT traj, sum(CASE WHEN query <> '' AND sub_goal <> '' THEN 0.25 ELSE 0 END + CASE WHEN n_words BETWEEN 3 AND 32 THEN 0.25 ELSE 0 END + CASE WHEN novel THEN 0.15 ELSE -0.5 END)::DOUBLE AS query_reward,
  sum(CASE WHEN says THEN -0.1 ELSE 0 END)::DOUBLE AS query_cost, sum(CASE WHEN says AND NOT novel THEN -0.2 ELSE 0 END)::DOUBLE AS query_repeat FROM nov GROUP BY traj),
term AS (SELECT t.*, coalesce(c.covered, 0) AS covered FROM (SELECT traj, arg_max(can_answer, round) AS can, CASE WHEN arg_max(can_answer, round) THEN arg_max(f1, round) ELSE 0.0 END AS f1, max(required) AS required, count(parse_error) AS errors, bool_or(fact_seen IS NOT NULL) AS hit FROM turns GROUP BY traj) t
  LEFT JOIN (SELECT traj, count(*) AS covered FROM graded WHERE first GROUP BY traj) c USING (traj))"""


def _query():
    k = F.col("k")
    said = F.concat(F.when(k % 3 == 0, "The ").otherwise(""), "event_type", F.lit("-"), k % 10, F.when(k % 4 == 0, "?").otherwise(""))
    return F.when(k % 7 == 0, F.when(k % 2 == 0, "").otherwise("The, a?")).otherwise(said)


def turns(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(F.col("user_id").alias("traj"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("round"), "event_type", "value", k.alias("k"))
    n = F.col("k") % 8
    chosen = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct((i < 6).alias("known"), F.when((F.col("k") + i) % 9 < 3, (F.col("k") + i) % 9).alias("fact")))
    return e.select(
        "traj", "round", _query().alias("query"), F.when(F.col("k") % 11 == 0, "").otherwise("goal").alias("sub_goal"), (F.col("k") % 40).alias("n_words"),
        F.when(F.col("k") % 5 < 3, F.array(F.col("k") % 5)).otherwise(F.array().cast("array<int>")).alias("retrieved"), chosen.alias("selected"), (F.col("event_type") == "purchase").alias("can_answer"),
        F.least(F.floor("value") / 100, F.lit(1.0)).alias("f1"), F.when((F.col("event_type") == "error") & (F.col("k") % 2 == 0), "query_retriever").alias("parse_error"), F.when(F.col("traj") % 6 == 0, 0).otherwise(3).alias("required"),
    )


@query(f"WITH {TURNS} SELECT traj, round, query, novel FROM nov")
def query_novelty(spark, sf_dir):
    return R.with_novelty(turns(spark, sf_dir)).select("traj", "round", "query", "novel")


@query(f"WITH {TURNS} SELECT traj, round(query_reward, 4) AS query_reward, round(query_cost, 4) AS query_cost, round(query_repeat, 4) AS query_repeat FROM qr")
def query_rewards(spark, sf_dir):
    return R.query_reward(turns(spark, sf_dir)).select("traj", *[F.round(c, 4).alias(c) for c in ("query_reward", "query_cost", "query_repeat")])


@query(f"WITH {TURNS} SELECT * FROM ebr")
def evidence_grades(spark, sf_dir):
    return R.evidence_by_round(turns(spark, sf_dir))


_ACTIONS = f"""WITH {TURNS}, gain AS (SELECT traj, round, count(*) AS gained FROM (SELECT traj, fact_seen, min(round) AS round FROM turns WHERE fact_seen IS NOT NULL GROUP BY traj, fact_seen) GROUP BY traj, round),
a AS (SELECT n.*, coalesce(gained, 0) AS gained, coalesce(unknown, 0) AS unknown, coalesce(irrelevant, 0) AS irrelevant, coalesce(covers, 0) AS covers, coalesce(again, 0) AS again,
  sum(coalesce(covers, 0)) OVER (PARTITION BY traj ORDER BY round) AS covered FROM nov n LEFT JOIN gain USING (traj, round) LEFT JOIN ebr USING (traj, round)),
acts AS (SELECT traj, round, 'query_retriever' AS role, CASE WHEN query <> '' AND sub_goal <> '' THEN 0.25 ELSE 0 END + CASE WHEN n_words BETWEEN 3 AND 32 THEN 0.25 ELSE 0 END + CASE WHEN novel THEN 0.15 ELSE -0.5 END - CASE WHEN says THEN 0.1 ELSE 0 END + 0.5 * gained - CASE WHEN parse_error IS NOT NULL THEN 1 ELSE 0 END AS reward FROM a
UNION ALL SELECT traj, round, 'update_evidence', CASE WHEN n_sel = 0 THEN -0.25 ELSE 0 END - 0.15 * greatest(n_sel - 5, 0) - 0.5 * unknown - 0.1 * irrelevant + covers - 0.1 * again FROM a
UNION ALL SELECT traj, round, 'answer', CASE WHEN can_answer THEN 2 * f1 ELSE 0 END + CASE WHEN NOT can_answer AND covered < required THEN 0.25 ELSE 0 END - CASE WHEN NOT can_answer AND required > 0 AND covered >= required THEN 0.5 ELSE 0 END - CASE WHEN can_answer AND covered < required THEN CASE WHEN f1 > 0 THEN 0.25 ELSE 1 END ELSE 0 END FROM a),
terminal AS (SELECT traj, 2 * f1 + CASE WHEN required = 0 THEN 0 ELSE least(1.0, covered / required) END + CASE WHEN can AND covered < required THEN CASE WHEN f1 > 0 THEN -0.25 ELSE -1 END ELSE 0 END - errors AS terminal FROM term)"""


@query(f"{_ACTIONS} SELECT traj, round, role, round(reward::DOUBLE, 4) AS reward FROM acts")
def action_rewards(spark, sf_dir):
    return R.action_rewards(turns(spark, sf_dir)).withColumn("reward", F.round("reward", 4))


@query(f"{_ACTIONS} SELECT traj, round(terminal::DOUBLE, 4) AS terminal FROM terminal")
def terminal_reward(spark, sf_dir):
    return R.terminal_reward(turns(spark, sf_dir)).withColumn("terminal", F.round("terminal", 4))


@query(f"""WITH {TURNS}, er AS (SELECT traj, sum(CASE WHEN n_sel = 0 THEN -0.25 ELSE 0 END - 0.15 * greatest(n_sel - 5, 0) - 0.5 * coalesce(unknown, 0) - 0.1 * coalesce(irrelevant, 0) + coalesce(covers, 0))::DOUBLE AS evidence_reward FROM turns LEFT JOIN ebr USING (traj, round) GROUP BY traj)
SELECT traj, round((0.25 * query_reward + 0.25 * evidence_reward + 2 * f1 + CASE WHEN required = 0 THEN 0 ELSE least(1.0, covered / 2) END + CASE WHEN hit THEN 0.5 ELSE 0 END + CASE WHEN errors = 0 THEN 0.25 ELSE 0 END + query_cost + query_repeat
  + CASE WHEN required > 0 AND can AND covered < 2 THEN CASE WHEN f1 > 0 THEN -0.25 ELSE -1 END ELSE 0 END - errors)::DOUBLE, 4) AS total FROM term JOIN qr USING (traj) JOIN er USING (traj)""")
def total_reward(spark, sf_dir):
    return R.total_reward(turns(spark, sf_dir)).withColumn("total", F.round("total", 4))


@query(f"WITH {TURNS} SELECT traj, round((2.0 * (f1 >= 0.5)::INTEGER + (covered > 0)::INTEGER + (errors = 0)::INTEGER - 0.05 * n - (errors > 0)::INTEGER)::DOUBLE, 4) AS reward FROM term JOIN (SELECT traj, count(*) AS n FROM turns GROUP BY traj) USING (traj)")
def reward_v0(spark, sf_dir):
    t = turns(spark, sf_dir)
    rows = R.terminal_parts(t).join(t.groupBy("traj").agg(F.count("*").alias("turns")), "traj").select("traj", (F.col("f1") >= 0.5).alias("match"), (F.col("covered") > 0).alias("supported"), (F.col("errors") == 0).alias("well_formed"), "turns", "errors")
    return R.reward_v0(rows).select("traj", F.round("reward", 4).alias("reward"))


_ADV = "CASE WHEN count(*) OVER {w} <= 1 THEN 0.0 ELSE ({x} - avg({x}) OVER {w}) / sqrt(greatest(var_pop({x}) OVER {w}, 1e-12)) END"


@query("SELECT event_id, round(" + _ADV.format(w="(PARTITION BY user_id, event_type)", x="value") + ", 5) AS advantage FROM events")
def group_advantage(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(R.advantage(F.col("value"), "user_id", "event_type"), 5).alias("advantage"))


@query(f"{_ACTIONS}, j AS (SELECT traj % 10 AS grp, a.*, CASE role WHEN 'query_retriever' THEN 0.75 WHEN 'update_evidence' THEN 0.7 ELSE 0.5 END AS w, t.terminal FROM acts a JOIN terminal t USING (traj)) SELECT traj, round, role, round((w * " + _ADV.format(w="(PARTITION BY grp, role, round)", x="reward::DOUBLE") + " + (1 - w) * " + _ADV.format(w="(PARTITION BY grp, role, round)", x="terminal::DOUBLE") + ")::DOUBLE, 4) AS advantage FROM j")
def action_advantage(spark, sf_dir):
    t = turns(spark, sf_dir)
    rows = R.action_rewards(t).join(R.terminal_reward(t), "traj").select("traj", "round", "role", (F.col("traj") % 10).alias("grp"), F.col("reward").alias("local"), "terminal")
    return R.action_advantage(rows, {"query_retriever": 0.75, "update_evidence": 0.7}).select("traj", "round", "role", F.round("advantage", 4).alias("advantage"))


@query("""WITH t AS (SELECT user_id AS grp, -value / 50 AS new, -value / 45 AS old, -value / 55 AS ref, (CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 - 3) / 2.0::DOUBLE AS adv, (event_type <> 'error')::INTEGER AS mask FROM events),
r AS (SELECT *, exp(new - old) AS ratio, least(greatest(exp(new - old), 0.8), 1.2) AS clipped, exp(ref - new) - (ref - new) - 1 AS kl FROM t), p AS (SELECT *, -least(ratio * adv, clipped * adv) AS policy FROM r)
SELECT grp, round(sum(policy * mask) / greatest(sum(mask), 1) + 0.1 * sum(kl * mask) / greatest(sum(mask), 1), 5) AS loss, round(sum(policy * mask) / greatest(sum(mask), 1), 5) AS policy, round(sum(kl * mask) / greatest(sum(mask), 1), 5) AS kl,
  round(avg(CASE WHEN abs(ratio - clipped) > 1e-8 THEN 1.0 ELSE 0.0 END)::DOUBLE, 5) AS clip_fraction FROM p GROUP BY grp""")
def grpo_loss(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    tokens = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), (-v / 50).alias("new"), (-v / 45).alias("old"), (-v / 55).alias("ref"), ((k % 7 - 3) / 2.0).alias("adv"), (F.col("event_type") != "error").cast("int").alias("mask"))
    return R.grpo_loss(tokens).select("grp", *[F.round(c, 5).alias(c) for c in ("loss", "policy", "kl", "clip_fraction")])


@query("WITH a AS (SELECT user_id, event_id, " + _ADV.format(w="(PARTITION BY user_id, event_type)", x="value") + " AS advantage FROM events) SELECT event_id FROM a WHERE user_id IN (SELECT user_id FROM a GROUP BY user_id HAVING max(abs(advantage)) > 1e-12)")
def zero_signal_skip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", R.advantage(F.col("value"), "user_id", "event_type").alias("advantage"))
    return R.with_signal(rows, "user_id").select("event_id")
