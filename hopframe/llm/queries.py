"""Queries of the training-data operators: each reads its whole table and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm.common import table
from hopframe.llm.cotraining import score_quality
from hopframe.llm.htmltext import extract_pages
from hopframe.llm.images import cropped_and_relit, drawn_vectors, find_copies
from hopframe.llm.mixing import mix_sources
from hopframe.llm.neardup import near_duplicates
from hopframe.llm.packing import pack_documents
from hopframe.llm.quality_rules import quality_verdicts
from hopframe.llm.secrets import scan_secrets
from hopframe.llm.substring import drop_repeated_passages
from hopframe.llm.toxicity import score_toxicity


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf_dir, "documents"), width=20)


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of the drawings of every vector whose id is divisible by 20, searched in all drawings."""
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), (F.col("vec_id") % 20 == 0).alias("is_query"), F.col("embedding").cast("array<float>").alias("content"))
    return find_copies(images, drawn_vectors("content"), cropped_and_relit)


def op9_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_page_text, op2_minhash_dedup, op3_mix_sources, op4_divergence_rules, op5_toxicity, op6_secret_scan, op7_repeated_passages, op8_image_copies, op9_cotraining_quality, op10_length_buckets)}
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
ORACLE_SQL: dict[str, str] = {
    "op1_page_text": """WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS inside FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(inside, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\\s+', ' ', 'g')) AS text FROM b) SELECT page_id, url, text, length(text) AS n_chars FROM c""",
    "op2_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct([array_to_string(words[i:i + 2], ' ') for i in range(1, len(words) - 1)]) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams FROM w),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT u, v FROM p WHERE 100 * m >= 85 * (na + nb - m)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(grams) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op7_repeated_passages": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
win AS (SELECT doc_id, p, array_to_string(words[p + 1:p + 20], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 19, 0))) AS p FROM w)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + i.range AS pos FROM later, range(20) i),
x AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM w),
k AS (SELECT x.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY x.pos) FILTER (gone.pos IS NULL) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.pos = x.pos GROUP BY x.doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
}
