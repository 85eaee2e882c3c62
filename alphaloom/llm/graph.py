"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node reachable, for each node that has an edge.

    Each step only takes minima by node (summed before the shuffle) and joins them back, so no group of nodes is
    ever gathered in one task. Rounds grow with the logarithm of the longest path; each is written to the shared
    scratch folder, so a lost executor costs one step. Self loops, repeated edges and an empty table are allowed.
    """
    e = stored(_ordered(edges))
    for _ in range(most_rounds):
        if _stars(e):
            break
        e = stored(_small_star(_large_star(e)))
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _ordered(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _ordered(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionByName(low.select("a", F.col("m").alias("b"))))


def _stars(e: DataFrame) -> bool:
    """Whether each node points to one root, and no root points further."""
    inner = e.join(e.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    twice = e.groupBy("a").count().where("count > 1").select("a")
    return not inner.unionByName(twice).take(1)
