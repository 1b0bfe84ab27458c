"""Rewards, advantages and losses over tables of turns.

``turns`` hold one row for each (traj, round): query, sub_goal, n_words, retrieved (fact
numbers seen), selected (structs of known and fact), can_answer, f1, parse_error (role or
null), required (facts of the trajectory) and, if some roles did not act, generated_roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions import text as X

EPS = 1e-12


def _when(c: Column, value: float) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit(value)).otherwise(0.0)


def with_novelty(turns: DataFrame) -> DataFrame:
    """``says``: the query has words beside articles; ``novel``: it says so for the first time in its trajectory."""
    w = Window.partitionBy("traj", "_norm").orderBy("round")
    t = turns.withColumn("_norm", X.normalize_reward("query")).withColumn("says", F.col("_norm") != "")
    return t.withColumn("novel", F.col("says") & (F.row_number().over(w) == 1)).drop("_norm")


def _filled(c: str) -> Column:
    return X.strip(F.coalesce(F.col(c), F.lit(""))) != ""


def query_reward(turns: DataFrame) -> DataFrame:
    """Per trajectory: query_reward, query_cost and query_repeat."""
    t = with_novelty(turns)
    value = _when(_filled("query") & _filled("sub_goal"), 0.25) + _when(F.col("n_words").between(3, 32), 0.25) + F.when(F.col("novel"), 0.15).otherwise(-0.5)
    return t.groupBy("traj").agg(F.sum(value).alias("query_reward"), F.sum(_when(F.col("says"), -0.1)).alias("query_cost"), F.sum(_when(F.col("says") & ~F.col("novel"), -0.2)).alias("query_repeat"))


def new_facts(turns: DataFrame, facts: Column, out: str) -> DataFrame:
    """(traj, round, out): facts met for the first time in that round."""
    met = turns.select("traj", "round", F.explode(facts).alias("fact")).where("fact is not null")
    return met.groupBy("traj", "fact").agg(F.min("round").alias("round")).groupBy("traj", "round").agg(F.count("*").alias(out))


def graded_selections(turns: DataFrame) -> DataFrame:
    """One row for each selected passage: known, fact, first (the first selection that covers the fact)."""
    rows = turns.select("traj", "round", F.posexplode("selected").alias("pos", "s"))
    rows = rows.select("traj", "round", "pos", "s.known", F.when(F.col("s.known"), F.col("s.fact")).alias("fact"))
    w = Window.partitionBy("traj", "fact").orderBy("round", "pos")
    return rows.withColumn("first", F.col("known") & F.col("fact").isNotNull() & (F.row_number().over(w) == 1))


def evidence_by_round(turns: DataFrame) -> DataFrame:
    """(traj, round) with counts of unknown, irrelevant, first and repeated selections."""
    g = graded_selections(turns)
    hit = F.col("known") & F.col("fact").isNotNull()
    return g.groupBy("traj", "round").agg(F.count_if(~F.col("known")).alias("unknown"), F.count_if(F.col("known") & F.col("fact").isNull()).alias("irrelevant"), F.count_if("first").alias("covers"), F.count_if(hit & ~F.col("first")).alias("again"))


def action_rewards(turns: DataFrame) -> DataFrame:
    """(traj, round, role, reward) for the roles that acted.

    Without any supporting fact there is no supervision: neither waiting nor answering is
    rewarded or punished for its evidence.
    """
    t = with_novelty(turns)
    t = t.join(new_facts(turns, F.col("retrieved"), "gained"), ["traj", "round"], "left").join(evidence_by_round(turns), ["traj", "round"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    so_far = Window.partitionBy("traj").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("covered", F.sum(zero("covers")).over(so_far))
    error = lambda role: _when(F.col("parse_error") == role, -1.0)
    n = F.size("selected")
    query = _when(_filled("query") & _filled("sub_goal"), 0.25) + _when(F.col("n_words").between(3, 32), 0.25) + F.when(F.col("novel"), 0.15).otherwise(-0.5) + _when(F.col("says"), -0.1) + 0.5 * zero("gained") + error("query_retriever")
    evidence = _when(n == 0, -0.25) - 0.15 * F.greatest(n - 5, F.lit(0)) - 0.5 * zero("unknown") - 0.1 * zero("irrelevant") + 1.0 * zero("covers") - 0.1 * zero("again") + error("update_evidence")
    can, taught = F.coalesce("can_answer", F.lit(False)), F.col("required") > 0
    enough, short = taught & (F.col("covered") >= F.col("required")), taught & (F.col("covered") < F.col("required"))
    answer = F.when(can, 2 * F.col("f1")).otherwise(0.0) + _when(~can & short, 0.25) + _when(~can & enough, -0.5) + F.when(can & short, F.when(F.col("f1") > 0, -0.25).otherwise(-1.0)).otherwise(0.0) + error("answer")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), v.alias("reward")) for r, v in (("query_retriever", query), ("update_evidence", evidence), ("answer", answer))])
    acted = F.filter(roles, lambda a: F.array_contains("generated_roles", a["role"])) if "generated_roles" in turns.columns else roles
    return t.select("traj", "round", F.explode(acted).alias("a")).select("traj", "round", "a.role", "a.reward")


def with_credit(actions: DataFrame, rewards: DataFrame) -> DataFrame:
    """``actions`` with the ``local`` reward of their (traj, role, round), 0 where there is none."""
    own = rewards.select("traj", "role", "round", F.col("reward").alias("local"))
    return actions.join(own, ["traj", "role", "round"], "left").withColumn("local", F.coalesce("local", F.lit(0.0)))


def terminal_parts(turns: DataFrame) -> DataFrame:
    """Per trajectory: last F1 if it answers, coverage, premature penalty, errors, retrieval hit."""
    covered = graded_selections(turns).where("first").groupBy("traj").agg(F.count("*").alias("covered"))
    last = turns.groupBy("traj").agg(F.max_by("can_answer", "round").alias("can"), F.max_by("f1", "round").alias("f1"), F.max("required").alias("required"), F.count("parse_error").alias("errors"), F.max(F.size("retrieved") > 0).alias("hit"))
    t = last.join(covered, "traj", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return t.withColumn("can", F.coalesce("can", F.lit(False))).withColumn("f1", F.when(F.col("can"), F.col("f1")).otherwise(0.0))


def _coverage(need: Column) -> Column:
    return F.when(need > 0, F.least(F.lit(1.0), F.col("covered") / need)).otherwise(0.0)


def terminal_reward(turns: DataFrame) -> DataFrame:
    """2 F1 + coverage of all facts + premature - errors."""
    t = terminal_parts(turns)
    short = F.col("can") & (F.col("covered") < F.col("required"))
    value = 2 * F.col("f1") + _coverage(F.col("required")) + F.when(short, F.when(F.col("f1") > 0, -0.25).otherwise(-1.0)).otherwise(0.0) - F.col("errors")
    return t.select("traj", value.alias("terminal"))


def total_reward(turns: DataFrame) -> DataFrame:
    """.25 query + .25 evidence + 2 F1 + coverage of two facts at most + hit + format + costs + premature - errors."""
    e = evidence_by_round(turns)
    n = F.size("selected")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = turns.join(e, ["traj", "round"], "left")
    evidence = rows.groupBy("traj").agg(F.sum(_when(n == 0, -0.25) - 0.15 * F.greatest(n - 5, F.lit(0)) - 0.5 * z("unknown") - 0.1 * z("irrelevant") + 1.0 * z("covers")).alias("evidence_reward"))
    t = terminal_parts(turns).join(query_reward(turns), "traj").join(evidence, "traj")
    need = F.least("required", F.lit(2))
    short = F.col("can") & (F.col("covered") < need) & (need >= 2)
    value = 0.25 * F.col("query_reward") + 0.25 * F.col("evidence_reward") + 2 * F.col("f1") + _coverage(need) + _when(F.col("hit"), 0.5) + _when(F.col("errors") == 0, 0.25) + F.col("query_cost") + F.col("query_repeat") + F.when(short, F.when(F.col("f1") > 0, -0.25).otherwise(-1.0)).otherwise(0.0) - F.col("errors")
    return t.select("traj", value.alias("total"))


def reward_v0(rows: DataFrame) -> DataFrame:
    """2 match + supported + format - 0.05 turns - [any error]."""
    value = 2.0 * F.col("match").cast("int") + F.col("supported").cast("int") + F.col("well_formed").cast("int") - 0.05 * F.col("turns") - (F.col("errors") > 0).cast("int")
    return rows.withColumn("reward", value)


def advantage(value: Column, *group: str) -> Column:
    """Value less its group's mean over its population deviation; a lone row is 0."""
    w = Window.partitionBy(*group)
    mean = F.avg(value).over(w)
    return F.when(F.count(value).over(w) <= 1, 0.0).otherwise((value - mean) / F.sqrt(F.greatest(F.var_pop(value).over(w), F.lit(EPS))))


def action_advantage(rows: DataFrame, weights: dict[str, float] | None = None, default: float = 0.5, bucket: tuple[str, ...] = ("grp", "role", "round")) -> DataFrame:
    """w * local + (1 - w) * terminal, both normalised within (group, role, round); ``weights`` holds w by role."""
    weights = weights or {}
    if not all(0 <= w <= 1 for w in (*weights.values(), default)):
        raise ValueError("weights must be in [0, 1]")
    weight = F.coalesce(*[F.when(F.col("role") == r, F.lit(float(w))) for r, w in weights.items()], F.lit(float(default)))
    return rows.withColumn("advantage", weight * advantage(F.col("local"), *bucket) + (1 - weight) * advantage(F.col("terminal"), *bucket))


def grpo_loss(tokens: DataFrame, epsilon: float = 0.2, beta: float = 0.1) -> DataFrame:
    """Loss, policy part, KL and clip fraction per group from (grp, new, old, ref, adv, mask) token rows.

    The clip fraction ignores the mask; other means are over masked tokens, at least one.
    """
    ratio = F.exp(F.col("new") - F.col("old"))
    clipped = F.least(F.greatest(ratio, F.lit(1 - epsilon)), F.lit(1 + epsilon))
    policy = -F.least(ratio * F.col("adv"), clipped * F.col("adv"))
    gap = F.col("ref") - F.col("new")
    kl = F.exp(gap) - gap - 1
    n = F.greatest(F.sum("mask"), F.lit(1))
    mean = lambda x: F.sum(x * F.col("mask")) / n
    return tokens.groupBy("grp").agg((mean(policy) + beta * mean(kl)).alias("loss"), mean(policy).alias("policy"), mean(kl).alias("kl"), F.avg(F.when(F.abs(ratio - clipped) > 1e-8, 1.0).otherwise(0.0)).alias("clip_fraction"))


def with_signal(rows: DataFrame, group: str) -> DataFrame:
    """Rows of groups whose advantages are not all nearly zero."""
    strong = rows.groupBy(group).agg(F.max(F.abs("advantage")).alias("m")).where(F.col("m") > EPS)
    return rows.join(strong.select(group), group, "left_semi")
