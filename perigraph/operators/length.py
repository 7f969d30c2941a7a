"""Physical lengths of diffusion times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import log_interpolate, over
from ..session import require
from .brackets import bracketed
from .crossing import first_at_least
from .fits import origin_fit
from .selection import keep_last


def shell_length(modes: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """-ln C = (ell^2 / 6) k^2 through the origin over shells (k2, correlation, sigma); NULL with under two usable shells.

    Weights are 1 / sigma_y^2, sigma_y = sigma / correlation, or 1 where sigma is missing or zero.
    """
    usable = modes.filter((F.col("correlation") > least) & (F.col("correlation") < 1)).withColumn("y", -F.ln("correlation"))
    usable = usable.withColumn("w", F.expr("case when sigma > 0 then correlation * correlation / (sigma * sigma) else 1D end"))
    out = origin_fit(usable, keys, "k2", "y", "w").filter("n >= 2")
    return out.select(*keys, "n", F.sqrt(6 * F.col("slope")).alias("ell"), (6 * F.col("slope")).alias("mean_square"), "relative_rmse")


def pooled_diffusivity(modes: DataFrame, keys: list[str], t_min: float, t_max: float, max_n2: int) -> DataFrame:
    """-ln C = D k^2 t over all modes in range: D, its error, r2, A = sqrt(6 D), error of A = 3 SE_D / A. Per-mode with keys."""
    usable = modes.filter(F.col("diffusion_time").between(t_min, t_max) & (F.col("n2") <= max_n2) & (F.col("correlation") > 0) & (F.col("correlation") < 1))
    usable = usable.withColumns({"x": F.col("k2") * F.col("diffusion_time"), "y": -F.ln("correlation")})
    out = origin_fit(usable, keys, "x", "y")
    a = F.sqrt(6 * F.col("slope"))
    return out.select(*keys, "n", F.col("slope").alias("d"), F.col("slope_se").alias("d_se"), "r2", a.alias("a_rms"), (3 * F.col("slope_se") / a).alias("a_rms_se"))


def radius_of(time: Column, a: float | Column) -> Column:
    return a * F.sqrt(time)


def calibration_error(time: Column, a_se: float | Column) -> Column:
    return a_se * F.sqrt(time)


def lengths_at(times: DataFrame, table: DataFrame, time: str = "diffusion_time", length: str = "length") -> DataFrame:
    """Length at each time (t) by the power law between the rows around it; NULL outside the table."""
    inside = log_interpolate(F.col("t"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    value = F.when(F.col("x0").isNotNull() & F.col("x1").isNotNull(), inside).when(F.col("t") == F.col("x0"), F.col("y0"))
    return bracketed(times, "t", table, time, length).select(*times.columns, value.alias("length"))


def merge_lengths(early: DataFrame, late: DataFrame, time: str = "diffusion_time") -> DataFrame:
    """Both tables; where a time is in both, the late one's row."""
    both = early.withColumn("_source", F.lit(0)).unionByName(late.withColumn("_source", F.lit(1)))
    return keep_last(both, [time], ["_source"]).drop("_source")


def containment_lengths(bins: DataFrame, fractions: list[float], tail_fraction: float = 0.2, max_tail_rise: float = 0.15, min_pairs: int = 100) -> DataFrame:
    """Per time of a binned distance curve (diffusion_time, r, pair_count, median): plateau and containment lengths.

    Bins with few pairs are left out; the running maximum of the median gives the curve. Its plateau is the median over
    the last share of bins and is accepted if these rise by no more than max_tail_rise of it. ell_f is the first r where
    the curve reaches the fraction f of the plateau, NULL if the plateau is not accepted or that lies in the tail.
    """
    used = bins.filter(F.col("pair_count") >= min_pairs)
    t = ["diffusion_time"]
    used = used.withColumn("curve", F.expr(f"max(median) {over(t, 'r', 'unbounded preceding and current row')}"))
    used = used.withColumns({"_n": F.expr(f"count(*) {over(t)}"), "_back": F.expr(f"row_number() {over(t, 'r desc')}")})
    used = used.withColumn("_tail", F.col("_back") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * tail_fraction)))
    tails = used.filter("_tail").groupBy(*t).agg(F.expr("percentile(curve, 0.5)").alias("plateau"), F.max("curve").alias("_hi"), F.min("curve").alias("_lo"), F.min("r").alias("tail_start"), F.count(F.lit(1)).alias("tail_bins"))
    tails = tails.withColumn("tail_rise", (F.col("_hi") - F.col("_lo")) / F.col("plateau")).withColumn("accepted", F.col("tail_rise") <= max_tail_rise)
    joined = used.join(tails, t)
    out = tails.select(*t, "plateau", "tail_start", "tail_bins", "tail_rise", "accepted")
    for f in fractions:
        name = f"ell_{f:g}".replace(".", "_")
        found = first_at_least(joined, t, "r", "curve", f"{f}D * plateau").withColumnRenamed("crossing", name)
        out = out.join(found, t, "left").withColumn(name, F.when(F.col("accepted") & (F.col(name) < F.col("tail_start")), F.col(name)))
    return out


def prefactor(df: DataFrame, x: str, y: str, weight: str = "1D") -> DataFrame:
    """Each row's compensated ratio y / (A x) and fractional residual, with A, their root mean square and largest size."""
    fit = origin_fit(df, [], x, y, weight).select(F.col("slope").alias("a"))
    out = df.crossJoin(F.broadcast(fit)).withColumn("ratio", F.col(y) / (F.col("a") * F.col(x)))
    return out.withColumn("residual", F.col("ratio") - 1)


def prefactor_summary(df: DataFrame, x: str, y: str, weight: str = "1D") -> DataFrame:
    return prefactor(df, x, y, weight).agg(F.max("a").alias("a"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"), F.max(F.abs("residual")).alias("largest"))


def with_lengths(curve: DataFrame, lengths: DataFrame, value: str = "ds", target: float = 3.0, tolerance: float = 0.03) -> DataFrame:
    """Inner join by time with an in-band flag; first_in_band marks the in-band row of smallest length."""
    out = curve.join(lengths, "diffusion_time").withColumn("in_band", F.abs(F.col(value) - target) <= tolerance)
    first = F.expr("min(case when in_band then length end) over ()")
    return out.withColumn("first_in_band", F.coalesce(F.col("in_band") & (F.col("length") == first), F.lit(False)))


def merged_harmonics(parts: list[DataFrame], expected: list[int]) -> DataFrame:
    """Union of per-harmonic tables; raises unless every time has exactly the expected harmonics."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    odd = out.groupBy("diffusion_time").agg(F.sort_array(F.collect_set("harmonic")).alias("h")).filter(F.col("h") != F.array(*[F.lit(h) for h in sorted(expected)]))
    require(odd.isEmpty(), "a time lacks a harmonic")
    return out


def adopted_calibration(candidates: DataFrame, preferred: str) -> DataFrame:
    """a: the recorded value if there is one (kind 'recorded'), else that of the preferred label, else the median."""
    pick = lambda cond: F.max(F.when(F.expr(cond), F.col("a")))
    return candidates.agg(F.coalesce(pick("kind = 'recorded'"), pick(f"label = '{preferred}'"), F.expr("percentile(a, 0.5)")).alias("a"))


def sensitivity(tests: DataFrame, value: str = "a", r2: str = "r2") -> DataFrame:
    """Spread and relative spread of a value over tests, range of r2."""
    return tests.agg((F.max(value) - F.min(value)).alias("spread"), ((F.max(value) - F.min(value)) / F.avg(value)).alias("relative_spread"), F.min(r2).alias("r2_min"), F.max(r2).alias("r2_max"))
