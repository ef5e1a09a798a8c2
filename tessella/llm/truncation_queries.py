"""Queries of the truncation operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import truncation
from tessella.session import materialise
from tessella.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_values(table(spark, sf_dir, "instance_results")).withColumnRenamed("id", "result_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(table(spark, sf_dir, "instance_results")).withColumnRenamed("source", "model")


def p4_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = materialise(truncation.value_ends(table(spark, sf_dir, "instance_results"), truncation.FIELDS), "ends")
    return truncation.length_hazards(ends).withColumnRenamed("source", "model")


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates, "p4_hazards": p4_hazards}
ORACLE: dict[str, str] = {}
