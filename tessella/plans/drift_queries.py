"""Queries of the drift operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import drift
from tessella.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.field_changes(table(spark, sf_dir, "metric_files"), table(spark, sf_dir, "metric_lines"))


def p1_instance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf_dir, "metric_files"), table(spark, sf_dir, "metric_lines"), "instance_metrics")


def p1_aggregate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = drift.consistent_table(table(spark, sf_dir, "metric_files"), table(spark, sf_dir, "metric_lines"), "aggregate_metrics")
    return t.withColumn("pair_ns", F.to_json("pair_ns"))


QUERIES = {"p1_found": p1_found, "p1_instance_metrics": p1_instance_metrics, "p1_aggregate_metrics": p1_aggregate_metrics}
ORACLE: dict[str, str] = {}
