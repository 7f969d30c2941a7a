"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges in a file of a round.
FILE_EDGES = 1 << 19


def large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for each node of the edges (a, b), which must have one type.

    Rounds grow with the logarithm of a component's diameter; each round is written to the shared folder.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.filter("a != b").select("a", "b").distinct(), "component-edges")
    before = None
    while before != (now := state(edges)):
        before = now
        if now[0] == 0:
            break
        # Rounds add no edges, so few edges are kept in few files.
        edges = materialize(small_star(large_star(edges)).coalesce(max(1, math.ceil(now[0] / FILE_EDGES))), "component-edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
