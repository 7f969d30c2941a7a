"""Graphs as edge tables (src, dst, w), both directions stored, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash_uniform, periodic_distance2
from ..session import materialize, require, small_side
from .selection import quantiles


def symmetrise(edges: DataFrame) -> DataFrame:
    """The larger weight of both directions, no self-loops, no zeros."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.filter("src != dst").groupBy("src", "dst").agg(F.max("w").alias("w")).filter("w != 0")


def neighbour_graph(neighbours: DataFrame, k: int | None = None) -> DataFrame:
    """Unweighted graph of a neighbour table, or of its first k ranks."""
    table = neighbours if k is None else neighbours.filter(F.col("rank") <= k)
    return symmetrise(table.select("src", "dst", F.lit(1.0).alias("w")))


def gaussian_graph(neighbours: DataFrame, k: int) -> DataFrame:
    """Weights exp(-d^2 / eps^2), eps the median distance of the k-th neighbours."""
    eps = quantiles(neighbours.filter(F.col("rank") == k), "dist", [0.5])[0]
    weight = F.exp(-(F.col("dist") * F.col("dist")) / (F.lit(eps) * F.lit(eps)))
    return symmetrise(neighbours.select("src", "dst", weight.alias("w")))


def degrees(edges: DataFrame, policy: str = "clamp") -> DataFrame:
    """id, degree (row sum). A zero degree is clamped to 1e-20 or raises, by policy."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w").cast("double")).alias("degree"))
    if policy == "raise":
        require(out.filter("degree <= 0").isEmpty(), "a node has no edges of positive weight")
        return out
    return out.withColumn("degree", F.greatest("degree", F.lit(1e-20)))


def coordinate_report(points: DataFrame, box: float) -> DataFrame:
    """One row: count, what is not finite or outside the box, and min, max, mean and deviation of each axis."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ok = finite("x") & finite("y") & finite("z")
    inside = ok & F.expr(" and ".join(f"{c} >= 0 and {c} < {box}" for c in "xyz"))
    stats = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    return points.agg(F.count(F.lit(1)).alias("n"), F.sum((~ok).cast("int")).alias("n_not_finite"), F.sum((~inside).cast("int")).alias("n_outside"), *stats)


def asymmetric_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is missing or has another weight."""
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w_back"))
    return edges.join(reverse, ["src", "dst"], "left").filter("w_back is null or w_back != w").select("src", "dst", "w", "w_back")


def graph_report(edges: DataFrame, n_nodes: int) -> DataFrame:
    """One row: nnz, diagonal entries, weights that are not finite, nodes without edges, least and mean degree."""
    per_node = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("src") == F.col("dst")).cast("int")).alias("loops"), F.sum((F.isnan("w") | F.col("w").isNull()).cast("int")).alias("odd"))
    return per_node.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"), F.coalesce(F.sum("loops"), F.lit(0)).alias("n_diagonal"), F.coalesce(F.sum("odd"), F.lit(0)).alias("n_not_finite"),
        (F.lit(n_nodes) - F.count("src")).alias("n_isolated"), F.min("n").alias("min_degree"), F.max("n").alias("max_degree"), (F.sum("n") / F.lit(float(n_nodes))).alias("mean_degree"),
    )


DEGREE_SHARES = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def degree_statistics(degree: DataFrame, column: str = "degree") -> DataFrame:
    """mean, population deviation and nine percentiles."""
    degree = materialize(degree.select(column), "statistics")
    out = degree.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return out.select("mean", "std", *[F.lit(q).cast("double").alias(f"q{round(100 * s):03d}") for s, q in zip(DEGREE_SHARES, quantiles(degree, column, DEGREE_SHARES), strict=True)])


def sample_edges(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return edges.withColumn("_draw", hash_uniform(F.lit(seed), F.col("src"), F.col("dst"))).orderBy("_draw", "src", "dst").limit(n).drop("_draw")


def sampled_reverse_check(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Of a sample of edges: how many there are and how many lack their reverse."""
    sample = sample_edges(edges, n, seed)
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("found", F.lit(1))
    joined = reverse.join(small_side(materialize(sample, "sampled-edges"), 64), ["src", "dst"], "right")
    return joined.agg(F.count(F.lit(1)).alias("n_sampled"), F.sum(F.when(F.col("found").isNull(), 1).otherwise(0)).alias("n_without_reverse"))


def edge_lengths(edges: DataFrame, points: DataFrame, box: float) -> DataFrame:
    """src, dst, length of the edges between located points."""
    sides = [points.select(F.col("id").alias(s), *[F.col(c).cast("double").alias(f"{c}_{s}") for c in "xyz"]) for s in ("src", "dst")]
    d2 = periodic_distance2([F.col(f"{c}_src") for c in "xyz"], [F.col(f"{c}_dst") for c in "xyz"], box)
    return edges.select("src", "dst").join(sides[0], "src").join(sides[1], "dst").select("src", "dst", F.sqrt(d2).alias("length"))


def induced_edges(edges: DataFrame, nodes: DataFrame, cap: int | None = None, seed: int = 0) -> DataFrame:
    """Each undirected edge once among the nodes (id); with a cap, a sample of so many."""
    own = edges.filter("src < dst")
    for side in ("src", "dst"):
        own = own.join(nodes.select(F.col("id").alias(side)), side, "left_semi")
    return own if cap is None else sample_edges(own, cap, seed)


def tile_periodic(points: DataFrame, box: float, margin: float) -> DataFrame:
    """The points with their 26 periodic images that lie within margin of the box: owner (id) and coordinates."""
    shift = F.array(*[F.lit(float(s)) for s in (-box, 0.0, box)])
    for c in "xyz":
        points = points.withColumn("_s", F.explode(shift)).withColumn(c, F.col(c) + F.col("_s")).drop("_s")
        points = points.filter((F.col(c) >= -margin) & (F.col(c) < box + margin))
    return points.withColumnRenamed("id", "owner")


def simplices_to_edges(simplices: DataFrame) -> DataFrame:
    """Unique undirected edges (src < dst) of tetrahedra given by their owners a, b, c, d."""
    corners = ["a", "b", "c", "d"]
    pairs = [F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst")) for i, p in enumerate(corners) for q in corners[i + 1 :]]
    return simplices.select(F.explode(F.array(*pairs)).alias("e")).select("e.src", "e.dst").filter("src != dst").distinct()


def reconcile(found: dict, recorded: dict, tolerance: float = 0.0) -> list[str]:
    """Names whose recorded value is missing or differs from what was found."""
    out = []
    for name, value in found.items():
        other = recorded.get(name)
        if other is None or (abs(value - other) > tolerance if isinstance(value, int | float) else value != other):
            out.append(name)
    return out
