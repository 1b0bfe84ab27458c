"""Raw rows of three shapes become canonical examples."""

from pyspark.sql import functions as F

from hopframe.operators import examples as E


def test_two_paragraph_rows(spark):
    raw = spark.sql("select 'q1' as id, ' Who  is it? ' as question, ' \n' as answer, 'bridge' as type, named_struct('title', array('A','B','A'), 'sent_id', array(0, 7, 0)) as supporting_facts, named_struct('title', array('A','B','C'), 'sentences', array(array('a0','a1'), array('b0'))) as context")
    row = E.two_paragraph_examples(raw, "dev").first()
    assert row["question"] == "Who is it?" and row["answer"] is None and not row["usable_for_sft"] and row["hop_count"] == 2
    assert [(f["title"], f["text"]) for f in row["supporting_facts"]] == [("A", "a0"), ("B", None)]
    assert row["quality_flags"] == ["missing_answer"] and len(row["context_doc_ids"]) == 2
    corpus = E.corpus_rows(raw, "hotpotqa").orderBy("pos").collect()
    assert [(r["title"], r["text"]) for r in corpus] == [("A", "a0 a1"), ("B", "b0")]
    assert [r["doc_id"] for r in corpus] == row["context_doc_ids"]


def test_evidence_rows(spark):
    raw = spark.sql("select '' as id, 'x9' as _id, 'q' as question, 'yes' as answer, 'compare' as type, cast(array() as array<struct<title:string,sent_id:int>>) as supporting_facts, cast(array() as array<struct<title:string,sentences:array<string>>>) as context, array(array('s','born in','o'), array('x')) as evidences")
    row = E.evidence_examples(raw, "train").first()
    assert row["qid"] == "x9" and row["usable_for_sft"] and not row["usable_for_retrieval_eval"]
    assert [tuple(c) for c in row["evidence_chain"]] == [(1, "s born in ?", "o")]
    none = E.evidence_examples(raw.withColumn("evidences", F.lit(None).cast("array<array<string>>")), "train").first()
    assert none["evidence_chain"] == [] and not none["usable_for_sft"]


def test_decomposed_rows(spark):
    raw = spark.sql("select 'm' as id, 'q' as question, 'a' as answer, array('b') as answer_aliases, {} as answerable, array(named_struct('idx', 0L, 'title', 'T ', 'paragraph_text', 'p  0'), named_struct('idx', 1L, 'title', 'U', 'paragraph_text', 'p1')) as paragraphs, array(named_struct('id', 1L, 'question', 'one', 'answer', 'x', 'paragraph_support_idx', 0L), named_struct('id', 2L, 'question', 'two', 'answer', 'y', 'paragraph_support_idx', 9L)) as question_decomposition".format("true"))
    row = E.decomposed_examples(raw, "dev").first()
    assert [(f["title"], f["text"]) for f in row["supporting_facts"]] == [("T", "p 0")] and row["hop_count"] == 2 and row["answer_aliases"] == ["b"]
    assert row["supporting_facts"][0]["doc_id"] == row["context_doc_ids"][0]
    assert E.decomposed_examples(raw.withColumn("answerable", F.lit(False)), "dev").count() == 0
    assert E.decomposed_examples(raw.withColumn("answerable", F.lit(None).cast("boolean")), "dev").count() == 1
