"""Comparing bootstrap distributions: paired, all pairs, censored.

All-pairs results come from ranks, never from the product of both samples. A rank is a running count in value order,
taken in two steps (over value ranges, then within one), so neither sample is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import over
from ..session import materialize

QUANTILES = {"q025": 0.025, "q16": 0.16, "median": 0.5, "q84": 0.84, "q975": 0.975}


def quantile_columns(df: DataFrame, keys: list[str], value: str, prefix: str, extra: list) -> DataFrame:
    marks = F.expr(f"percentile({value}, array({', '.join(map(str, QUANTILES.values()))}))")
    out = df.groupBy(*keys).agg(marks.alias("q"), *extra)
    rest = [c for c in out.columns if c not in ("q", *keys)]
    return out.select(*keys, *[F.col("q")[i].alias(f"{prefix}{n}") for i, n in enumerate(QUANTILES)], *rest)


def paired(first: DataFrame, second: DataFrame, value: str = "value") -> DataFrame:
    """b, first, second, delta (second - first), fraction of the first, for replicates where both are known."""
    joined = first.select("b", F.col(value).alias("first")).join(second.select("b", F.col(value).alias("second")), "b").filter("first is not null and second is not null")
    return joined.withColumns({"delta": F.col("second") - F.col("first"), "fraction": F.expr("try_divide(second - first, first)")})


def paired_summary(pairs: DataFrame) -> DataFrame:
    above, below = F.avg((F.col("delta") > 0).cast("double")).alias("probability_gt_0"), F.avg((F.col("delta") < 0).cast("double")).alias("probability_lt_0")
    return quantile_columns(pairs, [], "delta", "", [F.count(F.lit(1)).alias("n"), above, below])


def pair_order_counts(first: DataFrame, second: DataFrame, value: str = "value") -> DataFrame:
    """One row: n_pairs and how many pairs have second below, equal to and above first."""
    own = [d.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")) for d in (first, second)]
    both = own[0].select("v", F.col("n").alias("n1"), F.lit(0).cast("long").alias("n2")).unionByName(own[1].select("v", F.lit(0).cast("long").alias("n1"), F.col("n").alias("n2")))
    merged = both.groupBy("v").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    ranked = running_count(merged, "v", "n2")
    sums = ranked.agg(F.sum(F.col("n1") * F.col("before")).alias("n_below"), F.sum(F.col("n1") * F.col("n2")).alias("n_equal"), F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    return sums.select((F.col("t1") * F.col("t2")).alias("n_pairs"), "n_below", "n_equal", (F.col("t1") * F.col("t2") - F.col("n_below") - F.col("n_equal")).alias("n_above"))


def cuts_of(df: DataFrame, value: str, slices: int) -> list[float]:
    """Values that part the rows into slices of about equal numbers, however they are spread."""
    return sorted(set(df.approxQuantile(value, [i / slices for i in range(1, slices)], 0.2 / slices)))


def slice_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below a value."""
    return F.expr("0") if not cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value))


def running_count(df: DataFrame, value: str, n: str, slices: int = 64) -> DataFrame:
    """before: the sum of n over smaller values. Values are distinct; slices hold about equal numbers of them."""
    df = materialize(df, "ranked")
    sliced = df.withColumn("_slice", slice_of(F.col(value), cuts_of(df, value, slices)))
    base = sliced.groupBy("_slice").agg(F.sum(n).alias("_s")).withColumn("_base", F.expr("coalesce(sum(_s) over (order by _slice rows between unbounded preceding and 1 preceding), 0)")).drop("_s")
    inside = F.expr(f"coalesce(sum({n}) {over(['_slice'], value, 'unbounded preceding and 1 preceding')}, 0)")
    return sliced.withColumn("_in", inside).join(F.broadcast(base), "_slice").withColumn("before", F.col("_base") + F.col("_in")).drop("_slice", "_base", "_in")  # a row per slice


def counted(df: DataFrame, value: str) -> DataFrame:
    return materialize(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "counted")


def counts_below(first: DataFrame, second: DataFrame, cuts: list[float], at: list[float]) -> list[int]:
    """Of counted values: for each of some differences, how many pairs have second - first at or below it.

    All differences are answered by one shuffle: second's running counts, within slices, meet first's moved values.
    """
    sums = {r["s"]: r["n"] for r in second.groupBy(slice_of(F.col("v"), cuts).alias("s")).agg(F.sum("n").alias("n")).collect()}  # a row per slice
    base = [sum(n for s, n in sums.items() if s < i) for i in range(len(cuts) + 1)]
    number = F.posexplode(F.array(*[F.lit(float(x)) for x in at])).alias("i", "x")
    moved = first.select("v", "n", number).select("i", (F.col("v") + F.col("x")).alias("v"), F.col("n").alias("n1"), F.lit(0).cast("long").alias("n2"))
    still = second.select("v", F.col("n").alias("n2"), number).select("i", "v", F.lit(0).cast("long").alias("n1"), "n2")
    both = moved.unionByName(still).withColumn("s", slice_of(F.col("v"), cuts))
    upto = F.sum("n2").over(Window.partitionBy("i", "s").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    below = both.withColumn("upto", upto + F.element_at(F.array(*[F.lit(x).cast("long") for x in base]), F.col("s") + 1)).filter("n1 > 0")
    found = {r["i"]: r["n"] for r in below.groupBy("i").agg(F.sum(F.col("n1").cast("decimal(38,0)") * F.col("upto")).alias("n")).collect()}
    return [int(found.get(i, 0)) for i in range(len(at))]


def pair_differences(first: DataFrame, second: DataFrame, ranks: list[int], tolerance: float = 0.0, points: int = 15) -> dict[int, float]:
    """The differences second - first of these ranks (from 1, ascending) among all pairs of counted values.

    Each round counts the pairs at some points of every rank's interval, by ranks, never by pairs, and goes on in the part
    that holds the rank, until its ends are adjacent numbers or at most tolerance apart.
    """
    a, b = (d.agg(F.min("v"), F.max("v")).first() for d in (first, second))
    cuts = cuts_of(second, "v", 64)
    span = dict.fromkeys(ranks, (math.nextafter(b[0] - a[1], -math.inf), b[1] - a[0]))  # the value lies above the first end
    while True:
        grid = {}
        for r, (low, high) in span.items():
            inner = sorted({low + (high - low) * i / (points + 1) for i in range(1, points + 1)} - {low, high})
            inner = [x for x in inner if low < x < high]
            if inner and high - low > tolerance:
                grid[r] = inner
        if not grid:
            return {r: high for r, (_, high) in span.items()}
        at = sorted({x for own in grid.values() for x in own})
        n = dict(zip(at, counts_below(first, second, cuts, at), strict=True))
        for r, own in grid.items():
            low, high = span[r]
            span[r] = (max([low, *[x for x in own if n[x] < r]]), min([high, *[x for x in own if n[x] >= r]]))


def all_pairs_cdf(first: DataFrame, second: DataFrame, at: float, value: str = "value") -> float:
    """The share of pairs with second - first <= at."""
    row = pair_order_counts(first.withColumn(value, F.col(value) + at), second, value).first()
    return (row["n_below"] + row["n_equal"]) / row["n_pairs"]


def all_pairs_quantile(first: DataFrame, second: DataFrame, q: float, value: str = "value", tolerance: float = 0.0) -> float | None:
    """The least difference second - first whose share of all pairs reaches q; None if there is no pair."""
    a, b = counted(first, value), counted(second, value)
    total = math.prod(d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for d in (a, b))
    rank = max(1, math.ceil(q * total - 1e-9))
    return pair_differences(a, b, [rank], tolerance)[rank] if total else None


def independent_summary(first: DataFrame, second: DataFrame, value: str = "value") -> DataFrame:
    """Pairs, probabilities that the difference of independent draws is above and below zero; ties in neither."""
    out = pair_order_counts(first, second, value)
    return out.select("n_pairs", (F.col("n_above") / F.col("n_pairs")).alias("probability_gt_0"), (F.col("n_below") / F.col("n_pairs")).alias("probability_lt_0"))


def all_pairs_ratio(first: DataFrame, second: DataFrame, value: str = "value", tolerance: float = 1e-13) -> DataFrame:
    """One row: interpolated quantiles of all ratios first / second of positive values, and the number of pairs.

    The ratios are never made: the two beside each quantile are found as differences of logarithms, by ranks.
    """
    a, b = (counted(d.filter(F.col(value) > 0).select(F.ln(value).alias("v")), "v") for d in (first, second))
    total = math.prod(d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for d in (a, b))
    places = {n: (total - 1) * q for n, q in QUANTILES.items()}
    found = pair_differences(b, a, sorted({f(p) + 1 for p in places.values() for f in (math.floor, math.ceil)}), tolerance) if total else {}
    out = {}
    for n, p in places.items():
        low, high = (math.exp(found[f(p) + 1]) if total else None for f in (math.floor, math.ceil))
        out[n] = low + (p - math.floor(p)) * (high - low) if total else None
    return first.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in out.items()], F.lit(total).cast("long").alias("n_pairs"))


def ratio_bounds(first: DataFrame, second: DataFrame) -> DataFrame:
    """Conservative bounds of a ratio from the quantiles (q16, median, q84) of both."""
    a, b = (d.select(*[F.col(c).alias(f"{c}_{n}") for c in ("q16", "median", "q84")]) for d, n in ((first, "a"), (second, "b")))
    joined = a.crossJoin(b)  # one row each
    return joined.select((F.col("median_a") / F.col("median_b")).alias("ratio"), (F.col("q16_a") / F.col("q84_b")).alias("ratio_low"), (F.col("q84_a") / F.col("q16_b")).alias("ratio_high"))


def prediction_summary(pairs: DataFrame, close: float) -> DataFrame:
    """Of paired values: quantiles of delta, median ratio and fraction, P(|delta| < close), P(delta > 0), correlation."""
    extra = [
        F.count(F.lit(1)).alias("n"), F.expr("percentile(try_divide(second, first), 0.5)").alias("ratio_median"), F.expr("percentile(fraction, 0.5)").alias("fraction_median"),
        F.avg((F.abs("delta") < close).cast("double")).alias("probability_close"), F.avg((F.col("delta") > 0).cast("double")).alias("probability_gt_0"), F.corr("first", "second").alias("correlation"),
    ]
    return quantile_columns(pairs, [], "delta", "", extra)


def kaplan_meier(df: DataFrame, time: str = "time", event: str = "event", keys: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct event time: n_events, at_risk (those censored then included), survival. event is boolean."""
    keys = list(keys)
    each = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(event).cast("int")).alias("n_events"))
    each = each.withColumn("at_risk", F.expr(f"sum(_n) {over(keys, time, 'current row and unbounded following')}")).filter("n_events > 0")
    upto = over(keys, time, "unbounded preceding and current row")
    product = f"case when max(case when n_events = at_risk then 1 else 0 end) {upto} = 1 then 0D else exp(sum(case when n_events < at_risk then ln(1 - n_events / at_risk) else 0D end) {upto}) end"
    return each.select(*keys, time, "n_events", "at_risk", F.expr(product).alias("survival"))


def survival_quantile(curve: DataFrame, q: float, time: str = "time", keys: tuple[str, ...] = ()) -> DataFrame:
    """The first time where survival is down to 1 - q, NULL if it never is."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 1 - q + 1e-12, F.col(time))).alias("quantile"))


def censored_offsets(pairs: DataFrame) -> DataFrame:
    """Of observed or censored times against a prediction: offset (known) and lower bound (both), with their medians."""
    out = pairs.withColumns({"offset": F.when(F.col("event"), F.col("time") - F.col("predicted")), "lower_bound": F.col("time") - F.col("predicted")})
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("offset").alias("n_observed"), F.expr("percentile(offset, 0.5)").alias("offset_median"), F.expr("percentile(lower_bound, 0.5)").alias("lower_bound_median"), F.avg((F.col("lower_bound") > 0).cast("double")).alias("probability_bound_gt_0"))


def group_comparison(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Quantiles of the value by flag (boolean)."""
    return quantile_columns(df, [flag], value, "", [F.count(value).alias("n")])


def probability_greater(df: DataFrame, flag: str, value: str) -> DataFrame:
    """P(value with flag false > value with flag true) over all pairs, ties half, by ranks."""
    out = pair_order_counts(df.filter(F.col(flag)), df.filter(~F.col(flag)), value)
    return out.select("n_pairs", ((F.col("n_above") + F.col("n_equal") / 2) / F.col("n_pairs")).alias("probability"))


def curve_differences(runs: dict[str, DataFrame], base: str, value: str = "ds") -> DataFrame:
    """Quantiles per run and time of its value less the base run's, at the times that all runs have, replicates paired."""
    times = None
    for r in runs.values():
        t = r.select("t").distinct()
        times = t if times is None else times.intersect(t)
    first = runs[base].select("b", "t", F.col(value).alias("_base")).join(times, "t", "left_semi")
    out = None
    for name, r in runs.items():
        if name != base:
            d = first.join(r.select("b", "t", F.col(value).alias("_v")), ["b", "t"]).select(F.lit(name).alias("run"), "t", (F.col("_v") - F.col("_base")).alias("difference"))
            out = d if out is None else out.unionByName(d)
    return quantile_columns(out, ["run", "t"], "difference", "", [F.count("difference").alias("n")])


def flattened(summaries: dict[str, DataFrame]) -> DataFrame:
    """One table of one-row summaries, labelled."""
    out = None
    for name, s in summaries.items():
        one = s.withColumn("label", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def error_bars(df: DataFrame) -> DataFrame:
    return df.withColumns({"error_low": F.col("median") - F.col("q16"), "error_high": F.col("q84") - F.col("median")})


def value_range(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"), (F.max(value) - F.min(value)).alias("spread"))


def split_at(curve: DataFrame, at: str, limit: float) -> DataFrame:
    """part: main up to the limit, extended beyond; the last main row stands in both, so that the parts join."""
    main = curve.filter(F.col(at) <= limit).withColumn("part", F.lit("main"))
    last = main.agg(F.max_by(F.struct(*curve.columns), at).alias("r")).filter("r is not null").select("r.*").withColumn("part", F.lit("extended"))
    return main.unionByName(last).unionByName(curve.filter(F.col(at) > limit).withColumn("part", F.lit("extended")))


def common_range(first: DataFrame, second: DataFrame, at: str) -> DataFrame:
    """Rows of both curves (labelled run) up to the smaller of their largest places."""
    limit = first.agg(F.max(at).alias("a")).crossJoin(second.agg(F.max(at).alias("b"))).select(F.least("a", "b").alias("_limit"))
    both = first.withColumn("run", F.lit("first")).unionByName(second.withColumn("run", F.lit("second")))
    return both.crossJoin(F.broadcast(limit)).filter(F.col(at) <= F.col("_limit")).drop("_limit")
