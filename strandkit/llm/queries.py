"""The thin queries opN_* over the standard tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, extraction, language, media, mixing, quality, secrets, similarity, toxicity, urls
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.classes(table(spark, sf_dir, "documents"), words=4, threshold=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_ngram_jaccard_join, op3_toxicity, op4_quality, op5_url_filter, op6_decontamination, op7_media, op8_language, op9_secrets, op10_extraction]
    return {f.__name__: f for f in found}


#: Whole tables, whole texts, plain joins: what the operators must equal.
SQL = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.both >= 85 * (na.n + nb.n - p.both)),
reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.doc_id = d.doc_id
""",
    "op6_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark),
i AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 5) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2),
    lambda j: array_to_string(ws[j : j + least(len(ws), 5) - 1], ' '))) AS g FROM iw WHERE len(ws) > 0),
d AS MATERIALIZED (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j : j + k - 1], ' '))) AS g
  FROM dw, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
m AS (SELECT d.doc_id, i.item_id, count(*) AS n_shared FROM d JOIN i ON d.g = i.g AND d.k = i.k GROUP BY 1, 2)
SELECT m.doc_id, m.item_id, n.n_item, m.n_shared, CAST(m.n_shared AS DOUBLE) / n.n_item AS containment
FROM m JOIN n ON n.item_id = m.item_id WHERE 100 * m.n_shared >= 80 * n.n_item
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
