"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum, whose partial sums are combined before the shuffle, and a join with its written result;
both sides of that join are dealt by the join itself, so that adaptive execution can split a node with very many edges.
The number of edges never grows, and the number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 50


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge to another."""
    now = written(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(ROUNDS):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = written(both.filter(F.col("y") > F.col("x")).join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        moved = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        now = written(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError("components did not settle")


def _settled(edges: DataFrame) -> bool:
    """True if every component is a star: a node has one parent and no child, or only children.

    An edge points to a lesser node, so a star's centre is its least node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("parents"), F.lit(0).alias("children")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("parents"), F.lit(1).alias("children")))
    each = ends.groupBy("x").agg(F.sum("parents").alias("p"), F.sum("children").alias("c"))
    return each.agg(F.count_if((F.col("p") > 1) | ((F.col("p") > 0) & (F.col("c") > 0)))).first()[0] == 0
