"""Queries of the reply defect operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import defects
from tessella.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.pair_defects(table(spark, sf_dir, "instance_results")).withColumnRenamed("id", "result_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.defect_rates(table(spark, sf_dir, "instance_results")).withColumnRenamed("source", "model")


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
ORACLE: dict[str, str] = {}
