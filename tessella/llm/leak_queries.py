"""Queries of the leak index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import leaks
from tessella.sources.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p6_found": p6_found, "p6_matches": p6_matches, "p6_items": p6_items}
ORACLE: dict[str, str] = {}
