"""Queries over raw paragraphs: canonical corpus, alignment, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.functions import text as X
from hopframe.operators import corpus as C
from hopframe.operators import sampling as S
from hopframe.plans.registry import query, table

# Pieces of SQL shared by the queries below.
_NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
PARAGRAPHS = f"""
lined AS (SELECT doc_id AS row_ord, lang AS dataset, {_LINES} AS parts FROM documents),
split AS (SELECT row_ord, dataset, CASE WHEN len(parts) > 1 THEN parts[1] ELSE '' END AS title,
  CASE WHEN len(parts) > 1 THEN array_to_string(parts[2:], ' ') ELSE coalesce(parts[1], '') END AS body FROM lined),
para AS (SELECT *, dataset || ':' || sha1({_NORM.format("replace(lower(title), 'ß', 'ss') || ' ' || " + _NORM.format("body"))}) AS key FROM split),
corpus AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_ord) - 1 AS chunk_id
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_ord) AS n FROM para) WHERE n = 1)"""


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedupe_corpus(C.paragraphs(table(spark, sf_dir, "documents")))


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest, length({_NORM.format('text')}) AS n FROM documents")
def norm_text_hash(spark, sf_dir):
    norm = X.normalize_text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm).alias("digest"), F.length(norm).cast("long").alias("n"))


@query(f"WITH {PARAGRAPHS} SELECT row_ord, title, body FROM split")
def title_text_split(spark, sf_dir):
    return C.paragraphs(table(spark, sf_dir, "documents")).select("row_ord", "title", "body")


@query(f"WITH {PARAGRAPHS} SELECT row_ord, key FROM para")
def content_doc_id(spark, sf_dir):
    return C.paragraphs(table(spark, sf_dir, "documents")).select("row_ord", "key")


@query(f"WITH {PARAGRAPHS} SELECT row_ord, dataset, key, chunk_id FROM corpus")
def corpus_dedupe(spark, sf_dir):
    return _corpus(spark, sf_dir).select("row_ord", "dataset", "key", F.col("chunk_id").cast("long").alias("chunk_id"))


@query(f"WITH {PARAGRAPHS} SELECT key, string_agg(row_ord, ',' ORDER BY row_ord) AS linked, count(*) AS n_links FROM para GROUP BY key")
def linked_ids(spark, sf_dir):
    return C.linked_rows(C.paragraphs(table(spark, sf_dir, "documents")))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, unnest(range(0, len(parts))) AS sent_id, unnest(parts) AS sentence FROM s""")
def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(X.sentences("text")).alias("sent_id", "sentence")).withColumn("sent_id", F.col("sent_id").cast("long"))


@query()
def capitalized_phrases(spark, sf_dir):
    """Phrases and comparison entities of every document; word boundaries differ in DuckDB, so tests compare with Python."""
    docs = table(spark, sf_dir, "documents")
    phrases, entities = X.capitalized_phrases("text"), X.comparison_entities("text")
    return docs.select("doc_id", F.size(phrases).alias("n_phrases"), F.array_join(phrases, "|").alias("phrases"), F.array_join(entities, "|").alias("entities"))


@query(f"""WITH {PARAGRAPHS} SELECT chunk_id, dataset, regexp_replace(title || chr(10) || body, '^\\s+|\\s+$', '', 'g') AS chunk, 'q' || row_ord AS qid FROM corpus""")
def chunk_text(spark, sf_dir):
    chunk = X.strip(F.concat_ws("\n", "title", "body"))
    return _corpus(spark, sf_dir).select(F.col("chunk_id").cast("long").alias("chunk_id"), "dataset", chunk.alias("chunk"), F.concat(F.lit("q"), F.col("row_ord")).alias("qid"))


@query("""SELECT d.doc_id, CASE WHEN d.lang IS NULL OR trim(d.lang) = '' THEN 'no_dataset' WHEN regexp_replace(coalesce(d.text, ''), '\\s', '', 'g') = '' THEN 'no_question'
  WHEN l.quality IS NULL THEN 'no_answer' WHEN l.toxic IS NULL THEN 'no_facts' ELSE '' END AS reason, coalesce(l.quality = 1, true) AS usable
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def sample_validation(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left").select("doc_id", F.col("doc_id").alias("qid"), F.col("lang").alias("dataset"), F.col("text").alias("question"), F.col("quality").alias("answer"), F.col("toxic").alias("supporting_facts"), "quality")
    return C.validated(joined).select("doc_id", "reason", F.coalesce(F.col("quality") == 1, F.lit(True)).alias("usable"))


@query(f"""WITH b AS (SELECT item_id, replace(lower({_NORM.format('text')}), 'ß', 'ss') AS fact FROM benchmark), d AS (SELECT doc_id, replace(lower({_NORM.format('text')}), 'ß', 'ss') AS body FROM documents)
SELECT item_id, count(doc_id) AS n_docs, min(doc_id) AS first_doc, CASE WHEN count(doc_id) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS covered FROM b LEFT JOIN d ON contains(body, fact) GROUP BY item_id""")
def support_in_corpus(spark, sf_dir):
    """Facts found in the corpus: an equi-join on a fact's rarest possible key, its first eight words, then containment."""
    from hopframe.operators.matching import facts_in_corpus

    facts = table(spark, sf_dir, "benchmark").select("item_id", X.normalize_key("text").alias("fact"))
    docs = table(spark, sf_dir, "documents").select("doc_id", X.normalize_key("text").alias("body"))
    return facts_in_corpus(facts, docs)


@query(f"""WITH {PARAGRAPHS}, ext AS (SELECT page_id AS ext_ord, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)', 1) AS title, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS ext_body FROM pages),
c AS (SELECT row_ord, dataset AS title, CASE WHEN row_ord % 3 = 0 THEN '' ELSE body END AS body FROM split),
f AS (SELECT title, ext_body FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY ext_ord) n FROM ext) WHERE n = 1)
SELECT row_ord, CASE WHEN c.body = '' THEN coalesce(ext_body, '') ELSE c.body END AS filled FROM c LEFT JOIN f USING (title)""")
def external_backfill(spark, sf_dir):
    """Every third context has lost its text and takes it from the external pages by title."""
    context = C.paragraphs(table(spark, sf_dir, "documents")).select("row_ord", F.col("dataset").alias("title"), F.when(F.col("row_ord") % 3 == 0, "").otherwise(F.col("body")).alias("body"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ext_ord"), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)", 1).alias("title"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("ext_body"))
    return C.backfill(context, pages).select("row_ord", "filled")


@query(f"""WITH {PARAGRAPHS}, firsts AS (SELECT dataset, title, key AS corpus_key, body AS cb FROM (SELECT *, row_number() OVER (PARTITION BY dataset, title ORDER BY row_ord) k FROM corpus) WHERE k = 1)
SELECT s.row_ord, s.title, f.corpus_key, CASE WHEN f.corpus_key IS NULL THEN 'missing_supporting_doc' WHEN cb = '' THEN 'missing_supporting_fact_text' ELSE '' END AS flag FROM split s LEFT JOIN firsts f USING (dataset, title)""")
def align_to_corpus(spark, sf_dir):
    rows = C.paragraphs(table(spark, sf_dir, "documents"))
    return C.align_to_corpus(rows.select("row_ord", "dataset", "title"), C.dedupe_corpus(rows)).select("row_ord", "title", "corpus_key", "flag")


@query(f"WITH {PARAGRAPHS} SELECT c.row_ord, c.key FROM corpus c WHERE row_ord IN (SELECT doc_id FROM labels WHERE quality = 1)")
def corpus_extract(spark, sf_dir):
    needed = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("row_ord"))
    return C.extract_needed(_corpus(spark, sf_dir), needed, "row_ord").select("row_ord", "key")


@query(f"""WITH {PARAGRAPHS}, parts AS (SELECT *, CASE WHEN row_ord % 2 = 0 THEN 0 ELSE 1 END AS split_ord FROM para)
SELECT key, row_ord, split_ord FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY split_ord, row_ord) n FROM parts) WHERE n = 1""")
def union_corpora(spark, sf_dir):
    rows = C.paragraphs(table(spark, sf_dir, "documents"))
    return C.union_corpora([rows.where("row_ord % 2 = 0"), rows.where("row_ord % 2 <> 0")]).select("key", "row_ord", "split_ord")


@query("""SELECT lang AS dataset, source AS split, count(*) AS examples, count(*) FILTER (coalesce(quality, 0) = 1) AS usable, count(*) FILTER (toxic = 1) AS errors
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source""")
def split_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select(F.col("lang").alias("dataset"), F.col("source").alias("split"), (F.coalesce("quality", F.lit(0)) == 1).alias("usable"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("error"))
    return C.split_summary(rows)


@query("""WITH done AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND turn >= 3)
SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM done)""")
def resume_anti_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    done = turns.where("role = 'assistant' and turn >= 3").select("conv_id").distinct()
    return turns.select("conv_id").distinct().join(done, "conv_id", "left_anti")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return S.seeded_sample(table(spark, sf_dir, "documents"), "doc_id", 100, 42).select("doc_id", "lang")


@query("SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 20")
def per_group_sample(spark, sf_dir):
    return S.per_group_sample(table(spark, sf_dir, "documents"), "lang", "doc_id", 20, 42).select("doc_id", "lang", "rank")


@query("SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 50")
def balanced_round_robin(spark, sf_dir):
    return S.balanced(table(spark, sf_dir, "documents"), "lang", "doc_id", 50, 42).select("doc_id", "lang", "turn")


@query("SELECT doc_id, position, (position % 4)::INTEGER AS rank_no FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('45:' || doc_id), doc_id) - 1 AS position FROM documents)")
def epoch_order_shards(spark, sf_dir):
    return S.shard(S.epoch_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42, 3), "position", 4)


@query("""WITH ids AS (SELECT conv_id, row_number() OVER (ORDER BY md5('7:' || conv_id), conv_id) - 1 AS p FROM (SELECT DISTINCT conv_id FROM conversations)), n AS (SELECT floor(count(*) * 0.1) AS k FROM ids)
SELECT conv_id, turn, CASE WHEN p < k THEN 'val' ELSE 'train' END AS split FROM conversations JOIN ids USING (conv_id), n""")
def train_val_split(spark, sf_dir):
    return S.train_val(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", 0.1, 7)


@query("SELECT lang, doc_id, taken FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS taken FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE taken <= 25")
def quota_fill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return S.quota(docs, "lang", ["doc_id"], 25, F.col("quality") == 1).select("lang", "doc_id", "taken")


@query("""SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS pos, count(*) OVER (PARTITION BY host) AS host_pages FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages)""")
def page_positions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1).alias("host"))
    w = Window.partitionBy("host")
    return pages.select("page_id", "host", (F.row_number().over(w.orderBy("page_id")) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("host_pages"))
