"""Density homogeneity from counts in spheres (center, r_index, radius, count)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bootstrap import resampled_means
from .crossing import first_persistent, interpolated_crossing
from .fits import shifted_dimension


def with_scaled(curve: DataFrame, n_density: float, mean: str = "mean") -> DataFrame:
    """scaled: the mean count over that of a uniform distribution."""
    expected = n_density * 4 * math.pi / 3 * F.pow("radius", F.lit(3))
    return curve.withColumns({"expected": expected, "scaled": F.col(mean) / expected})


def density_curve(counts: DataFrame, n_density: float, width: int = 5) -> DataFrame:
    """Per radius: mean count, expected count, scaled count, and the correlation dimension d2 by shifted windows."""
    mean = counts.groupBy("radius").agg(F.avg("count").alias("mean"))
    return shifted_dimension(with_scaled(mean, n_density), [], "radius", "mean", width).withColumnRenamed("slope", "d2")


def with_joint_margin(curve: DataFrame, count_tolerance: float = 0.01, d2_tolerance: float = 0.03) -> DataFrame:
    """count_margin, d2_margin and margin, the smaller of both; unknown where the dimension is."""
    out = curve.withColumns({"count_margin": count_tolerance - F.abs(F.col("scaled") - 1), "d2_margin": d2_tolerance - F.abs(F.col("d2") - 3)})
    return out.withColumn("margin", F.when(F.col("d2_margin").isNotNull(), F.least("count_margin", "d2_margin")))


def bootstrap_scales(counts: DataFrame, multiplicity: DataFrame, n_density: float, width: int = 5, persistence: int = 3, count_tolerance: float = 0.01, d2_tolerance: float = 0.03) -> DataFrame:
    """b, discrete, interpolated: where each replicate of resampled centres meets both criteria persistently."""
    means = resampled_means(counts, multiplicity, "center", "radius", "count").drop("n")
    curve = shifted_dimension(with_scaled(means, n_density), ["b"], "radius", "mean", width).withColumnRenamed("slope", "d2")
    curve = with_joint_margin(curve, count_tolerance, d2_tolerance)
    discrete = first_persistent(curve, ["b"], "radius", "margin >= 0", persistence).withColumnRenamed("crossing", "discrete")
    smooth = interpolated_crossing(curve, ["b"], "radius", "margin", persistence=persistence, gate_previous=False).withColumnRenamed("crossing", "interpolated")
    return discrete.join(smooth, "b")
