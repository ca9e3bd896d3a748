"""The operators bound to the synthetic tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import html_extract, lines, media, mixing, ngram_join, packing, pii, quality, secrets, toxicity

TOKENIZER = "word_bpe_49k.json"
TOXIC_AT = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labelled = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    index, ids = toxicity.fit(docs, labelled)
    scored = toxicity.score(docs, index, ids)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "evidence")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.page_texts(_table(spark, sf_dir, "pages"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("quality")[f].alias(f) for f in fields])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.rates(docs, docs.select("doc_id", "lang"), domain="lang")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def queries() -> dict:
    own = (op1_line_dedup, op2_toxicity, op3_html_text, op4_media, op5_secrets, op6_ngram_join, op7_quality, op8_pii, op9_mixing, op10_packing)
    return {f.__name__: f for f in own}


#: Rows that the cascade keeps, in SQL: every count and rule over whole texts.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
  FROM d
), g AS (
  SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS tri
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS up, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_symbols / greatest(n_words, 1) <= 0.15
         AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 14.0
         AND up / greatest(letters, 1) <= 0.3
         AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM f
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
  UNION ALL SELECT doc_id, array_to_string(ws, chr(10)) FROM w WHERE len(ws) BETWEEN 1 AND 2
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 90 * (x.n + y.n - p.i)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_join": OP6_SQL, "op7_quality": OP7_SQL}
