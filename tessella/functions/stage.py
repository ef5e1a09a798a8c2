"""Columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns, each computed once per row.

    Projections are merged by the optimizer, which puts the expression of a column wherever it is used, also inside the
    lambda of an array function, where it would run per element. A generator of one row is not merged."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_settled")).select(*keep, *[F.col("_settled")[k].alias(k) for k in columns])
