"""Predictions from shell spectra (n2, k, p, n_modes) filtered by a heat kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import log_interpolate, three_point_gradient
from ..session import require
from .brackets import bracketed


def radius_grid(spark: SparkSession, radii: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(r),) for r in radii], "radius double")


def filtered_variance(shells: DataFrame, radii: DataFrame, volume: float, divisor: float = 6.0) -> DataFrame:
    """radius, sigma2 = sum of n_modes p exp(-(k radius)^2 / divisor) / volume; radii are a short list."""
    w2 = F.exp(-F.pow(F.col("k") * F.col("radius"), F.lit(2)) / divisor)
    joined = shells.crossJoin(F.broadcast(radii))  # every shell acts at every radius
    return joined.groupBy("radius").agg((F.sum(F.col("n_modes") * F.col("p") * w2) / volume).alias("sigma2"))


def log_derivatives(curve: DataFrame) -> DataFrame:
    """x = -d sigma2 / d ln radius and gamma = -d ln sigma2 / d ln radius, one-sided first order at the ends."""
    out = curve.withColumns({"lr": F.ln("radius"), "ls": F.ln("sigma2")})
    return out.withColumns({"x": -three_point_gradient("sigma2", "lr", [], 1), "gamma": -three_point_gradient("ls", "lr", [], 1)}).drop("lr", "ls")


def interpolate_at(points: DataFrame, table: DataFrame, x: str, y: str, scale: str = "linear", clamp: bool = True) -> DataFrame:
    """points (at) with value: the table's y between the rows around it; outside the end values, or NULL without clamp."""
    inside = log_interpolate(F.col("at"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) if scale == "log" else F.expr("y0 + (at - x0) * (y1 - y0) / (x1 - x0)")
    value = F.when(F.col("x0").isNotNull() & F.col("x1").isNotNull(), inside).when(F.col("at") == F.col("x0"), F.col("y0"))
    if clamp:
        value = value.otherwise(F.coalesce("y0", "y1"))
    return bracketed(points, "at", table, x, y).select(*points.columns, value.alias("value"))


def shell_contributions(shells: DataFrame, radius: float, divisor: float = 6.0, top: int = 20) -> DataFrame:
    """The shells that add most at a radius: contribution and its share of all, largest first."""
    w2 = F.exp(-F.pow(F.col("k") * radius, F.lit(2)) / divisor)
    out = shells.withColumn("contribution", F.col("n_modes") * F.col("p") * w2)
    total = out.agg(F.sum("contribution").alias("total"))
    out = out.crossJoin(F.broadcast(total)).withColumn("share", F.col("contribution") / F.col("total"))
    return out.select("n2", "k", "n_modes", "contribution", "share").orderBy(F.desc("contribution"), "n2").limit(top)


def same_geometry(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table, if both have the same shells with the same numbers of modes."""
    odd = first.select("n2", "n_modes").exceptAll(second.select("n2", "n_modes")).unionByName(second.select("n2", "n_modes").exceptAll(first.select("n2", "n_modes")))
    require(odd.isEmpty(), "the shells differ")
    return first


def power_ratios(first: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Joins on n2 the ratio of the first power to each of the others."""
    out = first.select("n2", "k", "n_modes", "p")
    for name, other in others.items():
        out = out.join(other.select("n2", F.col("p").alias(f"p_{name}")), "n2")
    return out.select("n2", "k", "n_modes", "p", *[f"p_{n}" for n in others], *[(F.col("p") / F.col(f"p_{n}")).alias(f"ratio_{n}") for n in others])


def filtered_ratio(first: DataFrame, second: DataFrame, radii: DataFrame, volume: float, divisor: float = 6.0) -> DataFrame:
    """Per radius: filtered variances of two spectra on their common shells and their ratio."""
    common = first.join(second.select("n2", F.col("p").alias("p_second")), "n2")
    a = filtered_variance(common, radii, volume, divisor).withColumnRenamed("sigma2", "sigma2_first")
    b = filtered_variance(common.withColumn("p", F.col("p_second")), radii, volume, divisor).withColumnRenamed("sigma2", "sigma2_second")
    return a.join(b, "radius").withColumn("ratio", F.col("sigma2_first") / F.col("sigma2_second"))


def band_summary(ratios: DataFrame, bands: DataFrame, ratio: str = "ratio") -> DataFrame:
    """Per band (band, k_lo, k_hi, half-open; they may overlap): n, median, q16, q84, exp of the mean log, mode-weighted."""
    joined = ratios.join(F.broadcast(bands), (F.col("k") >= F.col("k_lo")) & (F.col("k") < F.col("k_hi")))
    out = joined.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile({ratio}, array(0.16, 0.5, 0.84))").alias("q"), F.exp(F.avg(F.ln(ratio))).alias("log_mean"), (F.sum(F.col(ratio) * F.col("n_modes")) / F.sum("n_modes")).alias("weighted"))
    return out.select("band", "n", F.col("q")[1].alias("median"), F.col("q")[0].alias("q16"), F.col("q")[2].alias("q84"), "log_mean", "weighted")


def bias(shells: DataFrame, table: DataFrame) -> DataFrame:
    """Per shell within a linear spectrum (k, p): sqrt of the ratio to its log-log interpolation."""
    lin = interpolate_at(shells.withColumnRenamed("k", "at"), table, "k", "p", "log", clamp=False).withColumnRenamed("at", "k").withColumnRenamed("value", "p_lin")
    return lin.filter("p_lin > 0 and p > 0").withColumn("bias", F.sqrt(F.col("p") / F.col("p_lin")))


def effective_bias(biased: DataFrame, radius: float, divisor: float = 6.0) -> DataFrame:
    """Mode-weighted and heat-kernel-weighted bias over all shells."""
    w = F.col("n_modes") * F.exp(-F.pow(F.col("k") * radius, F.lit(2)) / divisor)
    ratio = lambda weight: F.sqrt(F.sum(weight * F.col("p")) / F.sum(weight * F.col("p_lin")))
    return biased.agg(ratio(F.col("n_modes")).alias("mode_bias"), ratio(w).alias("kernel_bias"), (F.sum(F.col("n_modes") * F.col("bias")) / F.sum("n_modes")).alias("mean_bias"))
