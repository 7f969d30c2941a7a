"""Resampling bootstrap.

Draws are a table of multiplicities (b, unit, c), so one join resamples everything, and a unit keeps its whole
trajectory. Means are taken before logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_normal

QUANTILES = {"q025": 0.025, "q16": 0.16, "median": 0.5, "q84": 0.84, "q975": 0.975}


def draws(spark: SparkSession, replicates: int, n: int, seed: int = 0) -> DataFrame:
    """b, i, unit: n draws with replacement of 0..n-1 for each replicate, by hashes."""
    out = spark.range(replicates).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return out.withColumn("unit", F.pmod(F.xxhash64(F.lit(seed), "b", "i"), F.lit(n)).cast("int"))


def lattice_draws(spark: SparkSession, replicates: int, n: int) -> DataFrame:
    """b, i, unit by an arithmetic rule that any engine can repeat; for comparisons, not for statistics."""
    out = spark.range(replicates * n).select(F.expr(f"id div {n}").alias("b"), (F.col("id") % n).alias("i"))
    return out.withColumn("unit", F.expr(f"cast(((b * 1103 + i * 7919 + b * i * 31 + b * b * 17) % 10007) % {n} as int)"))


def multiplicities(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("b", "unit").agg(F.count(F.lit(1)).alias("c"))


def resampled_means(values: DataFrame, counts: DataFrame, unit: str, at: str, value: str) -> DataFrame:
    """b, at, mean, n: the mean of the value over the drawn units at each place; one join and one aggregation."""
    joined = values.select(F.col(unit).alias("unit"), at, F.col(value).alias("_v")).join(counts, "unit")
    out = joined.groupBy("b", at).agg(F.sum(F.col("c") * F.col("_v")).alias("_s"), F.sum("c").alias("n"))
    return out.select("b", at, (F.col("_s") / F.col("n")).alias("mean"), "n")


def lognormal_curves(curve: DataFrame, replicates: int, at: str, mean: str, se: str, seed: int = 0) -> DataFrame:
    """b, at, mean: independent lognormal draws at each place, with the log deviation of the relative error."""
    spark = curve.sparkSession
    sigma = F.sqrt(F.ln(1 + F.pow(F.col(se) / F.col(mean), 2)))
    b = spark.range(replicates).withColumnRenamed("id", "b")
    out = curve.crossJoin(b)  # the product is what is asked for: every replicate draws at every place of one curve
    return out.select("b", at, F.exp(F.ln(mean) - sigma * sigma / 2 + sigma * hash_normal(F.lit(seed), "b", at)).alias("mean"))


def bands(df: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    """Exact interpolated quantiles of the values that are there, with n and the success fraction."""
    marks = F.expr(f"percentile({value}, array({', '.join(map(str, QUANTILES.values()))}))")
    out = df.groupBy(*keys).agg(marks.alias("q"), F.count(value).alias("n"), F.count(F.lit(1)).alias("n_all"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return out.select(*keys, *[F.col("q")[i].alias(f"{prefix}{n}") for i, n in enumerate(QUANTILES)], F.col("m").alias(f"{prefix}mean"), F.col("s").alias(f"{prefix}std"), F.col("n").alias(f"{prefix}n"), (F.col("n") / F.col("n_all")).alias(f"{prefix}success"))


def agreement(df: DataFrame, keys: list[str], value: str, target: float = 3.0, tolerance: float = 0.03) -> DataFrame:
    """probability_within (a missing value counts as outside), and whether there is a 95% band that holds the target."""
    inside = F.when(F.abs(F.col(value) - target) <= tolerance, 1.0).otherwise(0.0)
    q = F.expr(f"percentile({value}, array(0.025, 0.975))")
    out = df.groupBy(*keys).agg(F.avg(inside).alias("probability_within"), q.alias("q"))
    return out.select(*keys, "probability_within", F.coalesce((F.col("q")[0] <= target) & (F.col("q")[1] >= target), F.lit(False)).alias("ci_contains_target"))


def tail_probabilities(df: DataFrame, keys: list[str], tests: dict[str, str]) -> DataFrame:
    """The share of rows that pass each test (SQL text); rows where it is unknown are left out."""
    return df.groupBy(*keys).agg(*[F.avg(F.expr(f"cast(({t}) as double)")).alias(n) for n, t in tests.items()])


def replicate_amplitudes(df: DataFrame, x: str, y: str, points: int) -> DataFrame:
    """b, amplitude of y = amplitude * x for replicates that have all points."""
    out = df.filter(f"{x} is not null and {y} is not null").groupBy("b").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("amplitude"))
    return out.filter(F.col("n") == points).select("b", "amplitude")
