"""Queries of the shared span operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import spans
from tessella.sources.tables import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(table(spark, sf_dir, "documents"))


QUERIES = {"p8_found": p8_found, "p8_shared": p8_shared}
ORACLE = {
    "p8_found": """
WITH w AS (SELECT doc_id, substr(text, p + 1, 250) AS s FROM (SELECT doc_id, text, unnest(range(length(text) - 249)) AS p FROM documents WHERE length(text) >= 250)),
h AS (SELECT s FROM (SELECT DISTINCT doc_id, s FROM w) GROUP BY s HAVING count(*) > 1), k AS (SELECT DISTINCT doc_id, s FROM w SEMI JOIN h USING (s))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id"""
}
