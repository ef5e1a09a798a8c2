"""Queries of the quota sampling operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import quotas
from tessella.sources.tables import table


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in ("instances", "decisions", "curation_reports", "curation_targets")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas.unreachable(*_tables(spark, sf_dir))


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas.balanced_sample(*_tables(spark, sf_dir))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas.sample_report(*_tables(spark, sf_dir)).withColumn("shortfalls", F.to_json("shortfalls"))


QUERIES = {"p2_found": p2_found, "p2_sample": p2_sample, "p2_report": p2_report}
ORACLE = {
    "p2_found": """
WITH last AS (SELECT instance_id, max_by(lower(trim(decision)), decided_at) AS d FROM decisions GROUP BY 1),
e AS (SELECT DISTINCT i.curation_id, i.instance_id, lower(trim(i.label)) AS label, lower(trim(i.metadata.genre)) AS genre, lower(trim(i.metadata.length_bucket)) AS length
      FROM instances i LEFT JOIN last USING (instance_id) WHERE i.curation_id IS NOT NULL AND (d IS NULL OR d <> 'drop')),
n AS (SELECT curation_id, 'label' AS axis, label AS category, count(DISTINCT instance_id) AS n FROM e GROUP BY ALL
      UNION ALL SELECT curation_id, 'genre', genre, count(DISTINCT instance_id) FROM e GROUP BY ALL
      UNION ALL SELECT curation_id, 'length', length, count(DISTINCT instance_id) FROM e GROUP BY ALL)
SELECT DISTINCT t.curation_id, t.axis, lower(trim(t.category)) AS category
FROM curation_targets t JOIN curation_reports r USING (curation_id)
LEFT JOIN n ON n.curation_id = t.curation_id AND n.axis = t.axis AND n.category = lower(trim(t.category))
WHERE coalesce(n.n, 0) < greatest(coalesce(t.min_rows, 0), round(t.target_share * r.target_rows))
"""
}
