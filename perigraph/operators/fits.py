"""Log-log regression: windowed spectral dimensions and range fits.

Missing windows are NULL. The three edge policies are separate functions: strictly centred windows, windows shifted
inwards at the edges, and forward windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import over, three_point_gradient
from ..session import require


def logs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Columns lx and ly: natural logs, NULL where a value is not positive."""
    return df.withColumns({"lx": F.expr(f"case when {x} > 0 then ln(cast({x} as double)) end"), "ly": F.expr(f"case when {y} > 0 and not isnan({y}) then ln(cast({y} as double)) end")})


def centred_dimension(df: DataFrame, keys: list[str], x: str, y: str, width: int = 7, factor: float = -2.0) -> DataFrame:
    """ds = factor * slope over the centred window of width rows, r2, rms of the log residuals; NULL at the edges."""
    require(width >= 3 and width % 2 == 1, "the window must be odd and at least 3 wide")
    h = width // 2
    w = over(keys, x, f"{h} preceding and {h} following")
    full = f"count(lx + ly) {w} = {width}"
    rms = f"sqrt(greatest(0D, regr_syy(ly, lx) {w} - regr_sxy(ly, lx) {w} * regr_sxy(ly, lx) {w} / regr_sxx(ly, lx) {w}) / {width})"
    out = logs(df, x, y).withColumns({"ds": F.expr(f"case when {full} then {factor}D * regr_slope(ly, lx) {w} end"), "r2": F.expr(f"case when {full} then regr_r2(ly, lx) {w} end"), "rms": F.expr(f"case when {full} then {rms} end")})
    return out.drop("lx", "ly")


def shifted_dimension(df: DataFrame, keys: list[str], x: str, y: str, width: int = 5, factor: float = 1.0) -> DataFrame:
    """slope over windows of width rows that are shifted inwards at the edges; NULL if a log in the window is missing."""
    h = width // 2
    w, place = over(keys, x, f"{h} preceding and {width - 1 - h} following"), over(keys, x)
    out = logs(df, x, y).withColumns({"_n": F.expr(f"row_number() {place}"), "_all": F.expr(f"count(*) {over(keys)}")})
    out = out.withColumn("_slope", F.expr(f"case when _n > {h} and _n <= _all - {width - 1 - h} and count(lx + ly) {w} = {width} then {factor}D * regr_slope(ly, lx) {w} end"))
    whole = over(keys, x, "unbounded preceding and unbounded following")
    first = f"max(case when _n = {h + 1} then _slope end) {whole}"
    last = f"max(case when _n = _all - {width - 1 - h} then _slope end) {whole}"
    return out.withColumn("slope", F.expr(f"case when _n <= {h} then {first} when _n > _all - {width - 1 - h} then {last} else _slope end")).drop("_n", "_all", "_slope", "lx", "ly")


def forward_windows(df: DataFrame, keys: list[str], x: str, y: str, width: int, stride: int = 1, factor: float = -2.0) -> DataFrame:
    """One row per full forward window: keys, window (from 0), geometric mean of x, first and last x, ds, r2."""
    w, place = over(keys, x, f"current row and {width - 1} following"), over(keys, x)
    out = logs(df, x, y).withColumns({
        "window": F.expr(f"row_number() {place} - 1"), "_full": F.expr(f"count(lx + ly) {w} = {width}"), "x_mean": F.expr(f"exp(avg(lx) {w})"), "x_first": F.expr(f"min({x}) {w}"), "x_last": F.expr(f"max({x}) {w}"),
        "ds": F.expr(f"{factor}D * regr_slope(ly, lx) {w}"), "r2": F.expr(f"regr_r2(ly, lx) {w}"),
    })
    return out.filter(f"_full and window % {stride} = 0").select(*keys, "window", "x_mean", "x_first", "x_last", "ds", "r2")


def range_fits(df: DataFrame, ranges: DataFrame, keys: list[str], x: str, y: str, least: int = 3, factor: float = -2.0) -> DataFrame:
    """Per range (range_id, x_min, x_max, inclusive) and key: n, ds, its standard error, r2. Ranges are a short list."""
    joined = logs(df, x, y).join(F.broadcast(ranges), (F.col(x) >= F.col("x_min")) & (F.col(x) <= F.col("x_max"))).filter("lx is not null and ly is not null")
    out = joined.groupBy("range_id", *keys).agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"{f}(ly, lx)").alias(f) for f in ("regr_slope", "regr_r2", "regr_sxx", "regr_syy", "regr_sxy")])
    error = F.expr("case when n > 2 then sqrt(greatest(0D, regr_syy - regr_sxy * regr_sxy / regr_sxx) / (n - 2) / regr_sxx) end")
    return out.filter(F.col("n") >= least).select("range_id", *keys, "n", (factor * F.col("regr_slope")).alias("ds"), (abs(factor) * error).alias("ds_se"), F.col("regr_r2").alias("r2"))


def gradient_dimension(df: DataFrame, keys: list[str], x: str, y: str, y_se: str, factor: float = -2.0) -> DataFrame:
    """ds by second-order finite differences of the logs on an uneven grid, with the error of the neighbours by hypot."""
    out = logs(df, x, y).withColumn("_rel", F.col(y_se) / F.col(y))
    w = over(keys, "lx")
    before, after = f"coalesce(lag(_rel) {w}, _rel)", f"coalesce(lead(_rel) {w}, _rel)"
    span = f"(coalesce(lead(lx) {w}, lx) - coalesce(lag(lx) {w}, lx))"
    return out.withColumns({"ds": factor * three_point_gradient("ly", "lx", keys), "ds_se": F.expr(f"{abs(factor)}D * sqrt({before} * {before} + {after} * {after}) / {span}")}).drop("lx", "ly", "_rel")


def gated(value: str, r2: str, least: float) -> Column:
    """The value where the fit is good enough, else NULL."""
    return F.when(F.col(r2) >= least, F.col(value))


def fixed_slope_amplitude(df: DataFrame, keys: list[str], x: str, y: str, slope: float = -1.5) -> DataFrame:
    """amplitude of y = amplitude * x^slope, by the mean of the logs."""
    return logs(df, x, y).groupBy(*keys).agg(F.exp(F.avg(F.col("ly") - slope * F.col("lx"))).alias("amplitude"))


def power_law(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """exponent, amplitude, r2 of the free power law."""
    return logs(df, x, y).groupBy(*keys).agg(F.expr("regr_slope(ly, lx)").alias("exponent"), F.exp(F.expr("regr_intercept(ly, lx)")).alias("amplitude"), F.expr("regr_r2(ly, lx)").alias("r2"))


def window_summary(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Across probes: n, mean, median, deviation, its standard error, q16, q84, mean and least r2."""
    q = F.expr("percentile(ds, array(0.16, 0.5, 0.84))")
    out = fits.groupBy(*keys).agg(F.count("ds").alias("n"), F.avg("ds").alias("ds_mean"), F.stddev_samp("ds").alias("ds_std"), q.alias("q"), F.avg("r2").alias("r2_mean"), F.min("r2").alias("r2_min"))
    return out.select(*keys, "n", "ds_mean", F.col("q")[1].alias("ds_median"), "ds_std", (F.col("ds_std") / F.sqrt(F.col("n").cast("double"))).alias("ds_sem"), F.col("q")[0].alias("ds_q16"), F.col("q")[2].alias("ds_q84"), "r2_mean", "r2_min")


def range_summary(fits: DataFrame, target: float = 3.0) -> DataFrame:
    """Per range across probes: mean, error, and whether the target lies within one and two errors."""
    out = fits.groupBy("range_id").agg(F.count(F.lit(1)).alias("n_probes"), F.avg("ds").alias("ds_mean"), (F.stddev_samp("ds") / F.sqrt(F.count("ds").cast("double"))).alias("ds_sem"))
    off = F.abs(F.col("ds_mean") - target)
    return out.withColumns({"within_1_sem": off <= F.col("ds_sem"), "within_2_sem": off <= 2 * F.col("ds_sem")})


def compensated(df: DataFrame, x: str, y: str, y_se: str, low: float, high: float, power: float = 1.5, floor: float = 0.0) -> DataFrame:
    """y x^power over its median within [low, high], the error alike; floor is taken off y first."""
    out = df.withColumn("_c", (F.col(y) - floor) * F.pow(F.col(x).cast("double"), F.lit(power)))
    ref = out.filter(F.col(x).between(low, high)).agg(F.expr("percentile(_c, 0.5)").alias("_ref"))
    return out.crossJoin(F.broadcast(ref)).withColumns({"compensated": F.col("_c") / F.col("_ref"), "compensated_se": F.col(y_se) * F.pow(F.col(x).cast("double"), F.lit(power)) / F.col("_ref")}).drop("_c", "_ref")


def plateau(df: DataFrame, keys: list[str], x: str, value: str, x_min: float, strict: bool = False) -> DataFrame:
    """Mean of the value and its slope on ln x for x >= x_min; NULL with under three points, or raises if strict."""
    late = df.filter((F.col(x) >= x_min) & F.col(value).isNotNull())
    out = late.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_late"), F.avg(value).alias("plateau_mean"), F.expr(f"regr_slope({value}, ln(cast({x} as double)))").alias("plateau_slope"))
    if strict:
        require(out.filter("n_late < 3").isEmpty() and not out.isEmpty(), "fewer than three late points")
    return out.withColumns({c: F.when(F.col("n_late") >= 3, F.col(c)) for c in ("plateau_mean", "plateau_slope")})


def origin_fit(df: DataFrame, keys: list[str], x: str, y: str, weight: str = "1D") -> DataFrame:
    """y = slope * x with weights: n, slope, its standard error, r2 about the mean, rmse, relative rmse, chi2 and reduced chi2."""
    w, sums = weight, {}
    for name, e in {"sw": w, "swx": f"{w} * {x}", "swy": f"{w} * {y}", "sxx": f"{w} * {x} * {x}", "sxy": f"{w} * {x} * {y}", "syy": f"{w} * {y} * {y}", "xx": f"{x} * {x}", "xy": f"{x} * {y}", "yy": f"{y} * {y}", "sy": y}.items():
        sums[name] = F.expr(f"sum({e})")
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in sums.items()])
    out = out.withColumn("slope", F.col("sxy") / F.col("sxx"))
    out = out.withColumns({
        "chi2": F.expr("greatest(0D, syy - 2 * slope * sxy + slope * slope * sxx)"),
        "sse": F.expr("greatest(0D, yy - 2 * slope * xy + slope * slope * xx)"),
    })
    return out.select(
        *keys, "n", "slope", F.expr("case when n > 1 then sqrt(chi2 / (n - 1) / sxx) end").alias("slope_se"), F.expr("1 / sqrt(sxx)").alias("slope_formal_se"),
        F.expr("try_divide(yy - sy * sy / n - sse, yy - sy * sy / n)").alias("r2"), F.expr("sqrt(sse / n)").alias("rmse"), F.expr("try_divide(sqrt(sse / n), sqrt(yy / n))").alias("relative_rmse"), "chi2", F.expr("case when n > 1 then chi2 / (n - 1) end").alias("reduced_chi2"),
    )
