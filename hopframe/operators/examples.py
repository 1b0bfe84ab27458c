"""Canonical examples and corpus rows from raw QA rows of three shapes.

Context and facts stay arrays inside the row, so an example is built without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopframe.functions import text as X
from hopframe.operators.corpus import answerable_only, decomposition_chain, evidence_chain, fact_pairs, nested_or_flat


def _blank_to_null(c: Column) -> Column:
    return F.nullif(X.normalize_text(c), F.lit(""))


def context_entries(df: DataFrame, name: str = "context", out: str = "entries") -> DataFrame:
    """(title, sentences) from a struct of arrays or an array of structs; zips to the shorter side."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StructType):
        n = F.least(F.size(c["title"]), F.size(c["sentences"]))
        made = F.zip_with(F.slice(c["title"], 1, n), F.slice(c["sentences"], 1, n), lambda t, s: F.struct(t.alias("title"), s.alias("sentences")))
    else:
        made = F.transform(c, lambda e: F.struct(e["title"].alias("title"), e["sentences"].alias("sentences")))
    return df.withColumn(out, F.coalesce(made, F.array().cast("array<struct<title:string,sentences:array<string>>>")))


def _facts(dataset: str, pairs: Column, entries: Column) -> Column:
    """Facts with the sentence of the last context entry of their title; distinct, first order kept."""

    def one(p: Column) -> Column:
        entry = F.try_element_at(F.filter(entries, lambda e: e["title"] == p["title"]), F.lit(-1))
        sentence = X.normalize_text(F.when(p["sent_id"] >= 0, F.get(entry["sentences"], p["sent_id"])))
        key = X.doc_id(F.lit(dataset), p["title"], F.coalesce(sentence, F.lit("")))
        return F.struct(key.alias("doc_id"), p["title"].alias("title"), p["sent_id"].alias("sent_id"), sentence.alias("text"), F.lit("gold").alias("source"))

    return F.array_distinct(F.transform(pairs, one))


def _context_ids(dataset: str, entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda e: X.doc_id(F.lit(dataset), e["title"], F.array_join(e["sentences"], " "))))


def _qid(df: DataFrame) -> Column:
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "_id", "qid") if c in df.columns])


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _example(df: DataFrame, dataset: str, split: str, facts: Column, chain: Column, hops: Column, ids: Column, aliases: Column, usable: Column) -> DataFrame:
    answer = _blank_to_null(F.col("answer"))
    flags = F.array_compact(F.array(F.when(answer.isNull(), "missing_answer"), F.when(F.size(facts) == 0, "missing_supporting_facts")))
    return df.select(
        _qid(df).alias("qid"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), X.normalize_text("question").alias("question"), answer.alias("answer"), aliases.alias("answer_aliases"), _column(df, "type", "string").alias("question_type"), hops.cast("int").alias("hop_count"),
        facts.alias("supporting_facts"), chain.alias("evidence_chain"), ids.alias("context_doc_ids"), (answer.isNotNull() & usable).alias("usable_for_sft"), (F.size(facts) > 0).alias("usable_for_retrieval_eval"), flags.alias("quality_flags"),
    )


def _prepared(df: DataFrame) -> DataFrame:
    df = nested_or_flat(nested_or_flat(df, "supporting_facts"), "context")
    return context_entries(fact_pairs(df, "supporting_facts"))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


CHAIN = "struct<step:int,sub_question:string,answer:string>"


def two_paragraph_examples(df: DataFrame, split: str, dataset: str = "hotpotqa") -> DataFrame:
    """Rows with facts and contexts; two hops each."""
    df = _prepared(df)
    facts = _facts(dataset, F.col("pairs"), F.col("entries"))
    return _example(df, dataset, split, facts, _none(CHAIN), F.lit(2), _context_ids(dataset, F.col("entries")), _none("string"), F.size(facts) > 0)


def evidence_examples(df: DataFrame, split: str, dataset: str = "2wikimultihopqa") -> DataFrame:
    """Rows with evidences too, which make the chain and the hop count; usable with facts or a chain."""
    df = _prepared(df)
    facts, chain = _facts(dataset, F.col("pairs"), F.col("entries")), evidence_chain(F.col("evidences"))
    return _example(df, dataset, split, facts, chain, F.greatest(F.size(chain), F.lit(1)), _context_ids(dataset, F.col("entries")), _none("string"), (F.size(facts) > 0) | (F.size(chain) > 0))


def decomposed_examples(df: DataFrame, split: str, dataset: str = "musique") -> DataFrame:
    """Answerable rows with paragraphs and a decomposition, whose supported steps are the facts."""
    df = answerable_only(df) if "answerable" in df.columns else df
    paragraphs = F.transform("paragraphs", lambda p: F.struct(p["idx"].alias("idx"), X.normalize_text(F.coalesce(p["title"], F.lit(""))).alias("title"), X.normalize_text(p["paragraph_text"]).alias("paragraph_text")))
    df = df.withColumn("paragraphs", F.coalesce(paragraphs, F.array().cast("array<struct<idx:bigint,title:string,paragraph_text:string>>")))
    chain = decomposition_chain(F.coalesce("question_decomposition", F.array().cast("array<struct<id:bigint,question:string,answer:string,paragraph_support_idx:bigint>>")), F.col("paragraphs"))
    hit = F.filter(chain, lambda c: c["support_title"].isNotNull())
    facts = F.array_distinct(F.transform(hit, lambda c: F.struct(X.doc_id(F.lit(dataset), c["support_title"], c["support_text"]).alias("doc_id"), c["support_title"].alias("title"), F.lit(0).alias("sent_id"), c["support_text"].alias("text"), F.lit("gold").alias("source"))))
    ids = F.array_distinct(F.transform("paragraphs", lambda p: X.doc_id(F.lit(dataset), p["title"], p["paragraph_text"])))
    aliases = F.coalesce(_column(df, "answer_aliases", "array<string>"), _none("string"))
    steps = F.transform(chain, lambda c: F.struct(c["step"].alias("step"), c["sub_question"].alias("sub_question"), c["answer"].alias("answer")))
    return _example(df, dataset, split, facts, steps, F.size(chain), ids, aliases, F.size(facts) > 0)


def corpus_rows(df: DataFrame, dataset: str) -> DataFrame:
    """(doc_id, dataset, title, text, sentences) of every context entry, in order of qid and place; dedupe by doc_id follows."""
    df = context_entries(nested_or_flat(df, "context"))
    rows = df.select(_qid(df).alias("qid"), F.posexplode("entries").alias("pos", "e"))
    text = X.normalize_text(F.array_join("e.sentences", " "))
    sentences = F.transform("e.sentences", lambda s, i: F.struct(i.alias("sent_id"), X.normalize_text(s).alias("text")))
    return rows.select("qid", "pos", X.doc_id(F.lit(dataset), F.col("e.title"), text).alias("doc_id"), F.lit(dataset).alias("dataset"), X.normalize_text("e.title").alias("title"), text.alias("text"), sentences.alias("sentences"))
