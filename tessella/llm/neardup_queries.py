"""Queries of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import neardup
from tessella.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(table(spark, sf_dir, "instances"), "instance_id", "text")
    return pairs.toDF("instance_a", "instance_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "instances"), "instance_id", "text").withColumnRenamed("doc_id", "instance_id")


_PAIRS = r"""
WITH w AS (
  SELECT DISTINCT instance_id, lower(trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')) AS word
  FROM (SELECT instance_id, unnest(regexp_split_to_array(text, '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS w FROM instances WHERE text IS NOT NULL)
), k AS (SELECT instance_id, word FROM w WHERE word <> ''),
n AS (SELECT instance_id, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT a.instance_id AS a, b.instance_id AS b, count(*) AS c FROM k a JOIN k b ON a.word = b.word AND a.instance_id < b.instance_id GROUP BY 1, 2)
SELECT c.a AS instance_a, c.b AS instance_b FROM c JOIN n x ON x.instance_id = c.a JOIN n y ON y.instance_id = c.b
WHERE 5 * c.c >= 4 * (x.n + y.n - c.c)
"""

QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLE = {"p3_found": _PAIRS}
