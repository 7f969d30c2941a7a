"""Metric recovery: binned distance curves and how linear they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import require


def linear_bin(x: Column, first: float, width: float, n: int) -> Column:
    """Half-open bins; NULL outside."""
    index = F.floor((x - first) / width).cast("int")
    return F.when((index >= 0) & (index < n), index)


def log_bin(x: Column, first: float, last: float, n: int) -> Column:
    index = F.floor(n * F.ln(x / first) / F.ln(F.lit(last / first))).cast("int")
    return F.when((x >= first) & (x < last), F.least(index, F.lit(n - 1)))


def binned_curve(df: DataFrame, keys: list[str], x: str, y: str, first: float, width: float, n: int) -> DataFrame:
    """Per linear bin: center, pair_count, median, q16, q84."""
    out = df.withColumn("bin", linear_bin(F.col(x), first, width, n)).filter("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("pair_count"), F.expr(f"percentile({y}, array(0.16, 0.5, 0.84))").alias("q"))
    return out.select(*keys, "bin", (first + (F.col("bin") + 0.5) * width).alias("center"), "pair_count", F.col("q")[1].alias("median"), F.col("q")[0].alias("q16"), F.col("q")[2].alias("q84"))


def linearity(curve: DataFrame, keys: list[str], min_pairs: int = 50, min_bins: int = 5) -> DataFrame:
    """Through the origin over bins with enough pairs: linear_scale, relative_rmse, linear_r2 (squared correlation)."""
    used = curve.filter(F.col("pair_count") >= min_pairs)
    sums = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bins"), (F.sum(F.col("center") * F.col("median")) / F.sum(F.col("center") * F.col("center"))).alias("linear_scale"), F.avg("median").alias("m"), F.sum(F.col("median") * F.col("median")).alias("yy"), F.sum(F.col("center") * F.col("median")).alias("xy"), F.sum(F.col("center") * F.col("center")).alias("xx"), F.corr("center", "median").alias("r"))
    rmse = F.expr("sqrt(greatest(0D, yy - 2 * linear_scale * xy + linear_scale * linear_scale * xx) / n_bins)")
    return sums.filter(F.col("n_bins") >= min_bins).select(*keys, "n_bins", "linear_scale", (rmse / F.col("m")).alias("relative_rmse"), (F.col("r") * F.col("r")).alias("linear_r2"))


def weighted_bins(df: DataFrame, keys: list[str], bin_of: Column, x: str, y: str, w: str) -> DataFrame:
    """Per bin: n, weighted means of x and y, weighted deviation of y and its error, mean residual y - x."""
    out = df.withColumn("bin", bin_of).filter("bin is not null").groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(F.col(w) * F.col(w)).alias("sww"), F.sum(F.col(w) * F.col(x)).alias("swx"), F.sum(F.col(w) * F.col(y)).alias("swy"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("swyy"),
    )
    mean = F.col("swy") / F.col("sw")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("swyy") / F.col("sw") - mean * mean))
    return out.select(*keys, "bin", "n", (F.col("swx") / F.col("sw")).alias("x_mean"), mean.alias("y_mean"), std.alias("y_std"), (std * F.sqrt("sww") / F.col("sw")).alias("y_se"), ((F.col("swy") - F.col("swx")) / F.col("sw")).alias("residual"))


def identity_metrics(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """How well y equals x: n, rmse, fractional rmse, r2 about the identity, slope through the origin."""
    d = F.col(y) - F.col(x)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(F.expr(f"try_divide(({y} - {x}) * ({y} - {x}), {x} * {x})"))).alias("fractional_rmse"), F.sum(d * d).alias("sse"), F.expr(f"regr_syy({y}, {x})").alias("syy"), (F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"))
    return out.select(*keys, "n", "rmse", "fractional_rmse", F.expr("1 - try_divide(sse, syy)").alias("r2_identity"), "slope")


def require_bins(curve: DataFrame, n: int) -> DataFrame:
    require(curve.count() == n, f"not {n} bins have rows")
    return curve
