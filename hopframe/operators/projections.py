"""Record shapes: questions, examples, facts, evidence, predictions, errors, statuses.

Column functions take and give columns; table functions take and give tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions import text as X
from hopframe.operators.loop import supported

FACT_KEYS = ("doc_id", "title", "text")
#: Fields of the projections.
QUESTION_FIELDS = ("qid", "question", "answer", "split", "dataset", "question_type", "hop_count")
COMPACT_FIELDS = ("qid", "dataset", "question", "question_type", "hop_count")
UPDATE_FIELDS = ("selected_passage_ids", "rationale", "can_answer", "answer")
#: Parts of a message that, one of each list, mean that the infrastructure failed.
INFRASTRUCTURE_TERMS = ("spacy", "sentence-transformers", "sentence_transformers", "hopframe", "retrieval", "embedding", "graphml", "igraph", "module", "dependency", "index", "vllm", "openai", "chat completion")
FATAL_TERMS = ("missing", "cannot import", "install", "not found", "no such file", "failed", "connection refused", "timed out", "timeout")
#: Fixed value: the reason given for an answer that its evidence doesn't bear out.
UNSUPPORTED = "Current selected evidence does not support a final answer."


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def questions(examples: DataFrame) -> DataFrame:
    """The seven question fields; a missing question is empty."""
    return examples.select(*[_text(F.col(c)).alias(c) if c == "question" else F.col(c) for c in QUESTION_FIELDS])


def compact_examples(examples: DataFrame) -> DataFrame:
    """What a teacher may see of an example: no gold field."""
    return examples.select(*COMPACT_FIELDS)


def reward_samples(examples: DataFrame) -> DataFrame:
    return examples.select("answer", F.coalesce("answer_aliases", F.array().cast("array<string>")).alias("answer_aliases"), "supporting_facts")


def with_defaults(facts: Column) -> Column:
    """Facts with what older files lack: source is 'gold'; a missing list is empty."""
    kind = "array<struct<doc_id:string,title:string,sent_id:int,text:string,source:string>>"
    filled = F.transform(facts, lambda f: F.struct(f["doc_id"].alias("doc_id"), f["title"].alias("title"), f["sent_id"].cast("int").alias("sent_id"), f["text"].alias("text"), F.coalesce(f["source"], F.lit("gold")).alias("source")))
    return F.coalesce(filled.cast(kind), F.array().cast(kind))


def fact_items(facts: Column) -> Column:
    """Facts with trimmed doc_id, title and text (null where blank), without those that have none."""
    kept = lambda f, k: F.nullif(X.strip(_text(f[k])), F.lit(""))
    items = F.transform(F.coalesce(facts, F.array()), lambda f: F.struct(*[kept(f, k).alias(k) for k in FACT_KEYS]))
    return F.filter(items, lambda i: F.coalesce(*[i[k] for k in FACT_KEYS]).isNotNull())


def fact_groups(facts: Column) -> Column:
    """The non-blank values of each fact; their number is the number of facts required."""
    return F.transform(fact_items(facts), lambda i: F.array_compact(F.array(*[i[k] for k in FACT_KEYS])))


def fact_texts(facts: Column) -> Column:
    return F.flatten(fact_groups(facts))


def clean_evidence(evidence: Column) -> Column:
    """Evidence as the state shows it: passage_id, title and text only."""
    return F.coalesce(F.transform(evidence, lambda e: F.struct(*[e[k].alias(k) for k in ("passage_id", "title", "text")])), F.array().cast("array<struct<passage_id:int,title:string,text:string>>"))


def state_with(state_evidence: Column, evidence: Column) -> Column:
    """The state's evidence followed by the cleaned new one."""
    return F.concat(F.coalesce(state_evidence, F.array().cast("array<struct<passage_id:int,title:string,text:string>>")), clean_evidence(evidence))


def masked_update(payload: Column) -> Column:
    """JSON text of the allowed fields that the payload has, in fixed order; a field that is null stays null."""
    v = F.try_parse_json(payload)
    parts = []
    for k in UPDATE_FIELDS:
        one = F.try_variant_get(v, f"$.{k}", "variant")
        parts.append(F.when(one.isNotNull(), F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(one), F.lit("null")))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _first_filled(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def query_target(sub_goal: Column, sub_query: Column, query: Column) -> Column:
    """sub_goal and query of a query target from a plan and a retrieval, whichever is filled first."""
    return F.struct(_first_filled(sub_goal, sub_query, query).alias("sub_goal"), _first_filled(query, sub_query).alias("query"))


def compatible_query(query_retriever: Column, plan: Column, retrieval: Column) -> Column:
    """The query action of an output of the present shape, or else of the older plan and retrieval."""
    old = query_target(plan["sub_goal"], plan["sub_query"], retrieval["query"])
    pick = lambda k: X.strip(_text(F.when(query_retriever.isNotNull(), query_retriever[k]).otherwise(old[k])))
    return F.struct(pick("sub_goal").alias("sub_goal"), pick("query").alias("query"))


def compatible_ids(ids: Column, selected: Column, n: Column) -> Column:
    """Chosen passages (by ids, or else by passage_id or rank of the older list) in range, each once, in order."""
    raw = F.coalesce(ids, F.transform(selected, lambda s: F.coalesce(s["passage_id"], s["rank"])), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: x.try_cast("int")), lambda i: i.isNotNull() & (i >= 0) & (i < n)))


def retrieval_action(query: Column, passages: Column) -> Column:
    return F.struct(X.strip(_text(query)).alias("query"), F.size(F.coalesce(passages, F.array())).alias("top_k"))


def infrastructure_error(kind: Column, message: Column) -> Column:
    """Whether a run must end: a missing file, or a runtime error that names a part and a failure."""
    low = F.lower(_text(message))
    names = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    return (kind == "FileNotFoundError") | ((kind == "RuntimeError") & names(FATAL_TERMS) & names(INFRASTRUCTURE_TERMS))


def predictions(results: DataFrame) -> DataFrame:
    """Prediction rows from results; those with an ``error`` keep only what the sample says."""
    failed = F.col("error").isNotNull()
    blank = lambda c, empty: F.when(failed, empty).otherwise(F.coalesce(F.col(c), empty)).alias(c)
    none = F.array().cast("array<string>")
    answer = F.when(failed, "").otherwise(_text(F.col("final_answer"))).alias("pred_answer")
    return results.select("qid", "dataset", "question", answer, F.col("answer").alias("gold_answer"), "answer_aliases", blank("trajectory", none), blank("parse_errors", none), F.when(failed, 0).otherwise(F.coalesce("retrieval_count", F.lit(0))).alias("retrieval_count"), "error")


def error_records(failed: DataFrame, stage: str) -> DataFrame:
    return failed.select("dataset", "qid", "question", F.lit(stage).alias("stage"), "error_type", "message")


def endpoint(index: Column, n: int) -> Column:
    """The endpoint of a request, dealt in turn."""
    return F.pmod(index, F.lit(n))


def sorted_json(pairs: Column) -> Column:
    """JSON text of a map with its keys in order; null values stay."""
    one = lambda e: F.concat(F.to_json(F.array(e["key"].cast("string"))), F.to_json(F.array(e["value"].cast("string"))))
    inner = F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.regexp_replace(one(e), r"^\[(.*)\]\[(.*)\]$", r"$1:$2"))
    return F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))


def lenient_bool(x: Column, fallback: bool) -> Column:
    """A setting as a truth value: 1, true, yes, y and their opposites in any case; other texts by being filled; null is the fallback."""
    low = F.lower(X.strip(x))
    return F.when(x.isNull(), fallback).when(low.isin("1", "true", "yes", "y"), True).when(low.isin("0", "false", "no", "n"), False).otherwise(x != "")


def context_backfilled(context: DataFrame, facts: DataFrame, external: DataFrame) -> DataFrame:
    """``(qid, pos, title, sentences)``: contexts completed from a corpus.

    A title without sentences takes the corpus's; titles of facts that the context lacks follow
    after it, once each in fact order, if the corpus has sentences for them.
    ``context(qid, pos, title, sentences)``, ``facts(qid, ord, title)``, ``external(title, sentences)``.
    """
    known = external.where(F.size("sentences") > 0).select("title", F.col("sentences").alias("_own"))
    filled = context.join(known, "title", "left").select("qid", "pos", "title", F.when(F.coalesce(F.size("sentences"), F.lit(0)) > 0, F.col("sentences")).otherwise(F.coalesce("_own", F.array().cast("array<string>"))).alias("sentences"))
    lacking = facts.groupBy("qid", "title").agg(F.min("ord").alias("ord")).join(context.select("qid", "title").distinct(), ["qid", "title"], "left_anti").join(known, "title")
    size = context.groupBy("qid").agg((F.max("pos") + 1).alias("_n"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("ord")) - 1
    added = lacking.withColumn("_k", place).join(size, "qid", "left").select("qid", (F.coalesce("_n", F.lit(0)) + F.col("_k")).cast("long").alias("pos"), "title", F.col("_own").alias("sentences"))
    return filled.select("qid", F.col("pos").cast("long").alias("pos"), "title", "sentences").unionByName(added)


def selected_passages(turns: DataFrame) -> DataFrame:
    """``(traj, round, pos, passage)``: a turn's evidence, or else its observed passages with the chosen ids.

    ``turns(traj, round, evidence, passages, ids)``; where two passages share an id the last counts.
    """
    has = F.coalesce(F.size("evidence"), F.lit(0)) > 0
    found = F.array_compact(F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.try_element_at(F.filter("passages", lambda p: p["passage_id"].cast("string") == i.cast("string")), F.lit(-1))))
    return turns.select("traj", "round", F.posexplode(F.when(has, F.col("evidence")).otherwise(found)).alias("pos", "passage"))


def _agrees(p: dict[str, Column], f: dict[str, Column]) -> Column:
    """A passage bears a fact: equal ids if both have one, else equal titles if both have one, else one text within the other."""
    norm = lambda c: X.normalize_reward(c)
    whole = norm(F.concat_ws(" ", *[_text(p[k]) for k in FACT_KEYS]))
    needle = norm(f["text"])
    inside = (whole != "") & (needle != "") & (F.contains(whole, needle) | F.contains(needle, whole))
    both = lambda k: (norm(p[k]) != "") & (norm(f[k]) != "")
    return F.when(both("doc_id"), norm(p["doc_id"]) == norm(f["doc_id"])).when(both("title"), norm(p["title"]) == norm(f["title"])).otherwise(F.coalesce(inside, F.lit(False)))


def matched_facts(passages: DataFrame, facts: DataFrame) -> DataFrame:
    """``passages`` with ``fact``, the least index of a fact of the same ``traj`` that the passage bears (null if none).

    ``passages(traj, ..., passage)``, ``facts(traj, items)`` with :func:`fact_items`; a trajectory
    has few facts, so they are looked through within the row.
    """
    t = passages.join(facts.select("traj", "items"), "traj", "left")
    p = {k: F.col(f"passage.{k}") for k in FACT_KEYS}
    hits = F.transform("items", lambda f, i: F.when(_agrees(p, {k: f[k] for k in FACT_KEYS}), i))
    return t.withColumn("fact", F.array_min(F.array_compact(hits))).drop("items")


def answer_supported_v0(answer: Column, evidence: Column) -> Column:
    """The folded answer is in the joined evidence; yes and no need any evidence."""
    joined, folded = X.normalize_key(_text(F.array_join(evidence, " "))), X.normalize_key(_text(answer))
    return F.when(folded == "", False).when(folded.isin("yes", "no"), joined != "").otherwise(F.contains(joined, folded))


def demoted(turns: DataFrame) -> DataFrame:
    """``turns(question, can_answer, answer, rationale, evidence)``; an answer that its evidence (titles and texts) doesn't bear out is taken back."""
    pieces = F.transform("evidence", lambda e: F.concat_ws(" ", _text(e["title"]), _text(e["text"])))
    can = F.coalesce("can_answer", F.lit(False))
    keep = ~can | F.coalesce(supported(F.col("question"), F.col("answer"), pieces, can), F.lit(False))
    return turns.withColumn("_keep", keep).withColumn("answer", F.when(F.col("_keep"), F.col("answer"))).withColumn("rationale", F.when(F.col("_keep"), F.col("rationale")).otherwise(UNSUPPORTED)).withColumn("can_answer", can & F.col("_keep")).drop("_keep")


def assembled(examples: DataFrame, turns: DataFrame) -> DataFrame:
    """One sample for each example: its turns up to the first that can answer, in order, and the last one's answer."""
    before = Window.partitionBy("qid").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    live = turns.withColumn("_b", F.coalesce(F.max(F.col("can_answer").cast("int")).over(before), F.lit(0))).where("_b = 0").drop("_b")
    grouped = live.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("round", "query", "can_answer", "answer"))).alias("trajectory"))
    t = examples.join(grouped, "qid", "left").withColumn("trajectory", F.coalesce("trajectory", F.array().cast(grouped.schema["trajectory"].dataType)))
    return t.select("qid", "dataset", "split", "question", F.col("answer").alias("gold_answer"), "question_type", "hop_count", "trajectory", F.try_element_at("trajectory", F.lit(-1))["answer"].alias("final_answer"))


def teacher_status(samples: DataFrame) -> DataFrame:
    """``samples(error_type, stage, errors, leaks)`` with ``status`` (failed, filtered or written) and ``reason``."""
    bad = F.coalesce(F.size("errors"), F.lit(0)) > 0
    status = F.when(F.col("error_type").isNotNull(), "failed").when(F.col("leaks") | bad, "filtered").otherwise("written")
    reason = F.when(F.col("error_type").isNotNull(), F.concat(F.col("stage"), F.lit(":"), F.col("error_type"))).when(F.col("leaks"), "forbidden_training_label_text").when(bad, X.filter_reason(F.get("errors", F.lit(0))))
    return samples.withColumn("status", status).withColumn("reason", reason)


def first_samples(samples: DataFrame, datasets: list[str], most: int | None) -> DataFrame:
    """Samples with records of the datasets in the given order, the first ``most`` of them; ``samples(dataset, ord, n_records)``."""
    place = F.array_position(F.array(*map(F.lit, datasets)), F.col("dataset"))
    kept = samples.where((place > 0) & (F.col("n_records") > 0))
    return kept if most is None else kept.orderBy(place, "ord").limit(most)


def blank_turns(states: DataFrame) -> DataFrame:
    """A snapshot of each state as a turn in which nothing has happened yet."""
    empty = lambda kind: F.lit(None).cast(kind)
    return states.select("traj", "round", "evidence", F.array().cast("array<string>").alias("generated_roles"), empty("string").alias("query"), F.array().cast("array<string>").alias("observed"), F.array().cast("array<int>").alias("ids"), F.lit(False).alias("can_answer"), empty("string").alias("answer"), empty("string").alias("parse_error_role"))


def with_parse_failure(turns: DataFrame, failures: DataFrame) -> DataFrame:
    """Turns whose output didn't parse get the role and stop: the roles after it did not act."""
    return turns.drop("parse_error_role").join(failures.select("traj", "round", F.col("role").alias("parse_error_role")), ["traj", "round"], "left")


def rejoined(inputs: DataFrame, results: DataFrame, key: str = "index") -> DataFrame:
    """``inputs`` with the results of equal ``key``; raises where the numbers of rows or the keys differ."""
    joined = inputs.join(results.withColumn("_there", F.lit(True)), key, "full_outer")
    sizes = inputs.agg(F.count("*").alias("n")).crossJoin(results.agg(F.count("*").alias("m"), F.count_distinct(key).alias("d"))).first()  # one row each
    if not sizes["n"] == sizes["m"] == sizes["d"]:
        raise ValueError(f"{sizes['m']} results ({sizes['d']} different) for {sizes['n']} inputs")
    return joined.withColumn(key, F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.lit("an input has no result")))).drop("_there")


def cached_retrieval(requests: DataFrame, cache: DataFrame | None, retrieve) -> tuple[DataFrame, DataFrame]:
    """(requests with ``result`` and ``hit``, cache): each folded query of a dataset is retrieved once.

    ``requests(index, dataset, query)``; ``retrieve`` adds ``result`` to (dataset, key, query).  A
    request is a hit if the cache or an earlier request of the batch has its key.
    """
    key = X.normalize_key(F.col("query"))
    asked = requests.withColumn("key", key)
    first = F.row_number().over(Window.partitionBy("dataset", "key").orderBy("index")) == 1
    asked = asked.withColumn("_first", first)
    fresh = asked.where("_first").select("dataset", "key", "query")
    if cache is not None:
        fresh = fresh.join(cache.select("dataset", "key"), ["dataset", "key"], "left_anti")
    new = retrieve(fresh).select("dataset", "key", "result")
    whole = new if cache is None else cache.unionByName(new)
    missed = fresh.select("dataset", "key", F.lit(True).alias("_miss"))
    out = asked.join(whole, ["dataset", "key"]).join(missed, ["dataset", "key"], "left")
    return out.select("index", "dataset", "query", "result", (~(F.coalesce("_miss", F.lit(False)) & F.col("_first"))).alias("hit")), whole


def cache_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("dataset").agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))


def node_union(entities: DataFrame, passages: DataFrame) -> DataFrame:
    """``(hash_id, content)`` of both; where an id is in both, the passage's content counts."""
    return passages.unionByName(entities.join(passages.select("hash_id"), "hash_id", "left_anti"))


def judge_score(response: Column) -> Column:
    """1 for a judge's 'correct' (trimmed, any case), else 0; no response is 0."""
    return F.when(F.lower(X.strip(response)) == "correct", 1.0).otherwise(0.0)


def judged(scored: DataFrame, group: str) -> DataFrame:
    """Means of the judge and the text metrics by ``group``; a judge that failed (null response) counts 0 beside the text metrics."""
    one = F.when(F.col("judge_error").isNull(), judge_score(F.col("response"))).otherwise(0.0)
    return scored.withColumn("judge", one).groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("judge", "contain", "exact", "f1")], F.count("judge_error").alias("judge_errors"))


def logged_samples(logs: DataFrame, per_epoch: int) -> DataFrame:
    """A line for each sample newly seen at a log with a loss: epoch, sample, loss; ``logs(run, step, seen, loss)``."""
    with_loss = logs.where("loss is not null")
    before = F.coalesce(F.max("seen").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    news = with_loss.withColumn("_last", before).where("seen > _last")
    at = news.withColumn("_s", F.explode(F.sequence(F.col("_last") + 1, F.col("seen")))).withColumn("_z", F.col("_s") - 1)
    return at.select("run", F.expr(f"_z div {per_epoch} + 1").alias("epoch"), (F.col("_z") % per_epoch + 1).alias("sample"), F.lit(per_epoch).alias("sample_total"), "loss")


def masked_preview(x: Column, n: int = 40) -> Column:
    """The first letters of a text with its digits masked, for check-only runs."""
    return F.regexp_replace(F.substring(X.normalize_text(x), 1, n), r"\d", "#")
