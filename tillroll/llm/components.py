"""Connected components by alternating large-star and small-star steps on a table of edges.

Every step groups by node and joins the group's smallest neighbour back, so a node with very many neighbours is
combined before the shuffle and split by the adaptive skew join. Edges are written to the shared folder after each
round, which cuts the lineage. The result has one row per node of an edge; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for all nodes of the edges (a, b), which are long."""
    held = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    before = held.agg(*mark).first()
    while True:
        held = stage(_small_star(_large_star(held)), "edges")
        now = held.agg(*mark).first()
        if now == before:
            break
        before = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
