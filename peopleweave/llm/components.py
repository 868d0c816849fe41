"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("parent").alias("u"), F.col("child").alias("v")).unionByName(edges.select(F.col("child").alias("u"), F.col("parent").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u AND v <> m").select(F.col("m").alias("parent"), F.col("v").alias("child")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("child").agg(F.min("parent").alias("m"))
    joined = edges.join(least, "child")
    moved = joined.filter("parent <> m").select(F.col("m").alias("parent"), F.col("parent").alias("child"))
    return joined.select(F.col("m").alias("parent"), "child").unionByName(moved).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(parent, child): the smallest node of each component with every other node of it, from edges (parent < child).

    Edges of a hot node are aggregated before the shuffle, and its joins can be split. The number of steps grows with the logarithm of
    the longest path. Every step is stored in the checkpoint folder.
    """
    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("parent", "child").cast("decimal(38,0)"))).first())

    edges = cut_lineage(edges.select("parent", "child").distinct())
    seen = mark(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = mark(edges)
        if now == seen:
            return edges
        seen = now
