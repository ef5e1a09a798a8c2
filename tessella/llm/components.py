"""Connected components of links, by alternating large-star and small-star steps over durable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in edges(a, b). Nulls and loops are left out; empty in, empty out.

    A star step links every neighbour of a node to the smallest of them; no node's neighbours are gathered in a row."""
    cur = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        two = _both_ways(cur)
        least = two.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = two.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        linked = large.join(least, "b")
        small = linked.select(F.col("m").alias("a"), F.col("b")).unionAll(linked.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        new = materialise(small, "edges")
        if new.exceptAll(cur).isEmpty() and cur.exceptAll(new).isEmpty():
            break
        cur = new
    roots = cur.select(F.col("a").alias("node")).distinct().join(cur.select(F.col("b").alias("node")), "node", "left_anti")
    return cur.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
