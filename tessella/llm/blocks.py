"""Pairs within groups of any size: large groups are cut into blocks, and each pair of blocks is a key of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise

#: Rows of a group in a block, about.
BLOCK = 2000


def pairs_within(rows: DataFrame, keys: list[str], own: list[str], block: int = BLOCK) -> DataFrame:
    """keys, {c}_a and {c}_b of every unordered pair of rows with equal keys, each pair once; rows whose own columns are
    equal aren't paired. A group of n rows is spread over (n / block) ** 2 / 2 keys, none of which holds more than about
    two blocks. Rows with a null key are in no pair."""
    kept = materialise(rows.select(*keys, *[c for c in rows.columns if c not in keys]), "grouped")
    large = materialise(kept.groupBy(*keys).count().where(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("_parts")), "large")
    if large.isEmpty():
        spread = kept.withColumns({"_parts": F.lit(1), "_part": F.lit(0)})
    else:
        spread = kept.join(large, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_part", F.pmod(F.xxhash64(*own), F.col("_parts")).cast("int"))
    rest = [c for c in kept.columns if c not in keys]
    a = spread.select(*keys, "_part", F.explode(F.expr("sequence(_part, _parts - 1)")).alias("_other"), *[F.col(c).alias(f"{c}_a") for c in rest])
    b = spread.select(*keys, F.explode(F.expr("sequence(0, _part)")).alias("_part"), F.col("_part").alias("_other"), *[F.col(c).alias(f"{c}_b") for c in rest])
    less = F.struct(*[f"{c}_a" for c in own]) < F.struct(*[f"{c}_b" for c in own])
    differ = F.struct(*[f"{c}_a" for c in own]) != F.struct(*[f"{c}_b" for c in own])
    return a.join(b, [*keys, "_part", "_other"]).where(F.when(F.col("_part") == F.col("_other"), less).otherwise(differ)).drop("_part", "_other")
