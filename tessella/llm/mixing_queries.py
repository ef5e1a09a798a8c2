"""Queries of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import mixing
from tessella.session import materialise
from tessella.sources.tables import table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(mixing.token_counts(table(spark, sf_dir, "documents")), "sizes")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixing.mixture_report(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return report.where("short and unfilled_slots > 0").select("source_name")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p7_found": p7_found, "p7_shares": p7_shares, "p7_mixture": p7_mixture}
# The SQL counts bytes: the tables' margins hold for any tokenizer, also for one whose tokens are bytes.
ORACLE = {
    "p7_found": """
WITH t AS (SELECT lower(trim(source_name)) AS source_name, sum(target_weight) AS w, max(max_repeats) AS r FROM mix_targets GROUP BY 1),
d AS (SELECT lower(trim(source)) AS source_name, sum(strlen(text)) AS n FROM documents GROUP BY 1)
SELECT source_name FROM t LEFT JOIN d USING (source_name) WHERE coalesce(n, 0) * r < w * (SELECT sum(n) FROM d)"""
}
