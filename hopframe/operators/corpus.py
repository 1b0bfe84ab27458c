"""Canonical examples and corpora: normalisation of raw QA rows, dedupe, alignment, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopframe.functions import text as X


def nested_or_flat(df: DataFrame, name: str) -> DataFrame:
    """Packs flattened dotted columns ``name.*`` into one struct; a nested column stays."""
    parts = [c for c in df.columns if c.startswith(f"{name}.")]
    if name in df.columns or not parts:
        return df
    packed = F.struct(*[F.col(f"`{c}`").alias(c[len(name) + 1 :]) for c in parts])
    return df.withColumn(name, packed).drop(*parts)


def fact_pairs(df: DataFrame, name: str, out: str = "pairs") -> DataFrame:
    """(title, sent_id) pairs from a struct of arrays, an array of structs or an array of pairs.

    A struct of arrays zips to its shorter side; pairs with blank titles go.
    """
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StructType):
        n = F.least(F.size(c["title"]), F.size(c["sent_id"]))
        pairs = F.zip_with(F.slice(c["title"], 1, n), F.slice(c["sent_id"], 1, n), lambda t, s: F.struct(t.alias("title"), s.cast("int").alias("sent_id")))
    elif isinstance(kind.elementType, T.StructType):
        pairs = F.transform(c, lambda f: F.struct(f["title"].alias("title"), f["sent_id"].cast("int").alias("sent_id")))
    else:
        pairs = F.transform(F.filter(c, lambda f: F.size(f) >= 2), lambda f: F.struct(f[0].alias("title"), f[1].cast("int").alias("sent_id")))
    empty = F.array().cast("array<struct<title:string,sent_id:int>>")
    return df.withColumn(out, F.coalesce(F.filter(pairs, lambda p: X.normalize_text(F.coalesce(p["title"], F.lit(""))) != ""), empty))


def answerable_only(df: DataFrame, flag: str = "answerable") -> DataFrame:
    """Rows that are not marked unanswerable; null stays."""
    return df.where(F.coalesce(F.col(flag), F.lit(True)))


def evidence_chain(evidences: Column) -> Column:
    """(step, sub_question, answer) from [subject, relation, object] lists of three or more."""
    full = F.filter(F.coalesce(evidences, F.array().cast("array<array<string>>")), lambda e: F.size(e) >= 3)
    return F.transform(full, lambda e, i: F.struct((i + 1).alias("step"), F.concat(e[0], F.lit(" "), e[1], F.lit(" ?")).alias("sub_question"), e[2].alias("answer")))


def decomposition_chain(steps: Column, paragraphs: Column) -> Column:
    """(step, sub_question, answer, title, text) from decomposition steps and paragraphs by idx."""

    def one(s: Column, i: Column) -> Column:
        hit = F.get(F.filter(paragraphs, lambda p: p["idx"] == s["paragraph_support_idx"]), F.lit(0))
        return F.struct((i + 1).alias("step"), s["question"].alias("sub_question"), s["answer"].alias("answer"), hit["title"].alias("support_title"), hit["paragraph_text"].alias("support_text"))

    return F.transform(steps, one)


def sentence_lookup(facts: DataFrame, context: DataFrame) -> DataFrame:
    """``facts(qid, pos, title, sent_id)`` with the sentence of ``context(qid, pos, title, sentences)``.

    Of duplicate titles the last counts; a title or number without a sentence gives null.
    """
    last = context.groupBy("qid", "title").agg(F.max_by("sentences", "pos").alias("sentences"))
    sentence = F.when(F.col("sent_id") >= 0, F.get("sentences", F.col("sent_id")))
    return facts.join(last, ["qid", "title"], "left").withColumn("text", sentence).drop("sentences")


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paragraphs(documents: DataFrame) -> DataFrame:
    """``(row_ord, dataset, title, body, key)`` of a table of raw paragraphs."""
    named = documents.select(F.col("doc_id").alias("row_ord"), F.col("lang").alias("dataset"), X.title_of("text").alias("title"), X.body_of("text").alias("body"))
    return named.withColumn("key", X.doc_id("dataset", "title", "body"))


def dedupe_corpus(rows: DataFrame) -> DataFrame:
    """First row of each content key, with a position in its dataset as ``chunk_id``."""
    first = first_rows(rows, ["key"], ["row_ord"])
    return first.withColumn("chunk_id", F.row_number().over(Window.partitionBy("dataset").orderBy("row_ord")) - 1)


def linked_rows(rows: DataFrame) -> DataFrame:
    """All row ids of each content key in order."""
    ids = F.transform(F.array_sort(F.collect_list("row_ord")), lambda x: x.cast("string"))
    return rows.groupBy("key").agg(F.array_join(F.array_distinct(ids), ",").alias("linked"), F.count("*").alias("n_links"))


def align_to_corpus(facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Facts get the key of the first corpus row of their title; flags tell what is missing."""
    first = first_rows(corpus, ["dataset", "title"], ["row_ord"]).select("dataset", "title", F.col("key").alias("corpus_key"), F.col("body").alias("corpus_body"))
    found = facts.join(first, ["dataset", "title"], "left")
    flag = F.when(F.col("corpus_key").isNull(), "missing_supporting_doc").when(F.col("corpus_body") == "", "missing_supporting_fact_text").otherwise("")
    return found.withColumn("flag", flag)


def extract_needed(corpus: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Corpus rows whose key is needed, in corpus order."""
    return corpus.join(needed.select(key).distinct(), key, "left_semi")


def backfill(context: DataFrame, external: DataFrame) -> DataFrame:
    """Empty texts of ``context(title, body)`` from the first external row of the title."""
    needed = context.where("body = ''").select("title").distinct()
    first = first_rows(external.join(needed, "title", "left_semi"), ["title"], ["ext_ord"]).select("title", F.col("ext_body"))
    return context.join(first, "title", "left").withColumn("filled", F.when(F.col("body") == "", F.coalesce("ext_body", F.lit(""))).otherwise(F.col("body")))


def union_corpora(parts: list[DataFrame]) -> DataFrame:
    """Corpora of all splits in order, then deduped by content."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("split_ord", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return first_rows(out, ["key"], ["split_ord", "row_ord"])


def split_summary(examples: DataFrame) -> DataFrame:
    """Rows, usable rows and errors by dataset and split."""
    return examples.groupBy("dataset", "split").agg(F.count("*").alias("examples"), F.count_if("usable").alias("usable"), F.count_if(F.col("error") != "").alias("errors"))


def validated(samples: DataFrame) -> DataFrame:
    """Samples with a ``reason``: blank id, dataset, question or answer, or facts that are no list."""
    blank = lambda c: F.coalesce(X.strip(F.col(c).cast("string")), F.lit("")) == ""
    reason = F.when(blank("qid"), "no_qid").when(blank("dataset"), "no_dataset").when(blank("question"), "no_question").when(blank("answer"), "no_answer").when(F.col("supporting_facts").isNull(), "no_facts").otherwise("")
    return samples.withColumn("reason", reason)
