"""Selection, filters, sampling and de-duplication."""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_uniform, minimum_image, periodic_distance2
from ..session import require


def target_count(density: float, box: float) -> int:
    """How many points a box of this side holds at a number density."""
    return round(density * box**3)


#: Bins of a histogram, and values of a bin that are gathered to be ordered.
BINS, GATHERED = 4096, 10_000
#: Blocks of a distance bin whose first pairs are found apart.
BLOCKS = 64


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 1, ascending), exactly. No step sorts or gathers the whole column.

    A histogram over the values' range finds the bins that hold the ranks; each is refined by a histogram of its own until
    its values fit an ordered gathering of bounded size or are all equal.
    """
    column = df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    low, high, total = column.agg(F.min("v"), F.max("v"), F.count("v")).first()
    wanted = sorted({r for r in ranks if 1 <= r <= total})
    ranges, found = [(low, high, 0, wanted)] if wanted else [], {}
    while ranges:
        following, small = [], []
        for least, most, before, own in ranges:
            if least == most:
                found |= dict.fromkeys(own, least)
                continue
            width = (most - least) / BINS
            inside = column.filter((F.col("v") >= least) & (F.col("v") <= most))
            index = F.least(F.floor((F.col("v") - least) / width), F.lit(BINS - 1)) if width > 0 else F.when(F.col("v") == most, 1).otherwise(0)
            for row in inside.groupBy(index.alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("bin").collect():
                here = [r for r in own if before < r <= before + row["n"]]
                if here:
                    (small if row["n"] <= GATHERED else following).append((row["least"], row["most"], before, here))
                before += row["n"]
        if small:
            any_bin = reduce(Column.__or__, [(F.col("v") >= a) & (F.col("v") <= b) for a, b, _, _ in small])
            values = sorted(r["v"] for r in column.filter(any_bin).collect())  # at most GATHERED for each rank
            for least, _, before, here in small:
                start = bisect_left(values, least)
                found |= {r: values[start + r - before - 1] for r in here}
        ranges = following
    return found


def order_statistic(df: DataFrame, value: str, n: int) -> float | None:
    """The n-th largest value, exactly; None if there are fewer."""
    require(n >= 1, "n must be positive")
    total = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
    return order_statistics(df, value, [total - n + 1]).get(total - n + 1) if total >= n else None


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles, exactly, in bounded memory; None where there is no value. df is read several times."""
    total = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
    places = [(total - 1) * s for s in shares]
    found = order_statistics(df, value, [r for p in places for r in (math.floor(p) + 1, math.ceil(p) + 1)]) if total else {}
    return [None if not total else found[math.floor(p) + 1] + (p - math.floor(p)) * (found[math.ceil(p) + 1] - found[math.floor(p) + 1]) for p in places]


def threshold_members(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """n_above, n_equal."""
    v = F.col(value)
    return df.agg(F.sum(F.when(v > threshold, 1).otherwise(0)).alias("n_above"), F.sum(F.when(v == threshold, 1).otherwise(0)).alias("n_equal"))


def exact_top(df: DataFrame, value: str, n: int, row_order: list[str]) -> DataFrame:
    """Exactly n rows of largest value; ties at the threshold are filled in row order.

    Everything above the threshold passes by a filter; only the tied rows are ordered.
    """
    threshold = order_statistic(df, value, n)
    if threshold is None:
        return df.filter(F.col(value).isNotNull())
    above = df.filter(F.col(value) > threshold)
    ties = df.filter(F.col(value) == threshold).orderBy(*row_order).limit(n - above.count())
    return above.unionByName(ties)


def uniform_sample(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows without replacement, by the hash of their key."""
    draw = hash_uniform(F.lit(seed), *[F.col(k) for k in key])
    return df.withColumn("_draw", draw).orderBy("_draw", *key).limit(n).drop("_draw")


def nearest_point(points: DataFrame, centre: tuple[float, float, float], box: float) -> DataFrame:
    """id of the point nearest to a centre under periodicity, the smaller id on ties."""
    d2 = periodic_distance2([F.col(c) for c in "xyz"], [F.lit(float(c)) for c in centre], box)
    return points.agg(F.min_by("id", F.struct(d2, F.col("id"))).alias("id"))


def cube_around(points: DataFrame, centre: tuple[float, float, float], half_side: float, box: float) -> DataFrame:
    """Points strictly within half_side of the centre along every axis, with signed differences dx, dy, dz."""
    out = points.withColumns({f"d{c}": minimum_image(F.col(c) - float(m), box) for c, m in zip("xyz", centre, strict=True)})
    return out.filter((F.abs("dx") < half_side) & (F.abs("dy") < half_side) & (F.abs("dz") < half_side))


def stratified_pairs(pairs: DataFrame, distance: str, edges: list[float], per_bin: int, order: list[Column]) -> DataFrame:
    """per_bin pairs of each distance bin (half-open), in the order given; raises if a bin has fewer."""
    bins = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        bins = F.when((F.col(distance) >= a) & (F.col(distance) < b), i).otherwise(bins)
    binned = pairs.withColumn("bin", bins).filter("bin is not null")
    # Of each block of a bin only its first per_bin are ordered with the rest, so no task orders a whole bin.
    block = F.pmod(F.xxhash64(*pairs.columns), F.lit(BLOCKS))
    for group in (["bin", block.alias("_block")], ["bin"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        binned = binned.withColumn("_rank", rank).filter(F.col("_rank") <= per_bin).drop("_rank")
    chosen = binned
    short = {r["bin"]: r["count"] for r in chosen.groupBy("bin").count().collect()}
    lacking = [i for i in range(len(edges) - 1) if short.get(i, 0) < per_bin]
    require(not lacking, f"bins {lacking} have fewer than {per_bin} pairs")
    return chosen


def random_pairs(points: DataFrame, n_pairs: int, n_points: int, box: float, seed: int = 0) -> DataFrame:
    """n_pairs draws of two different points by row number (column rank from 0), with their periodic distance."""
    spark = points.sparkSession
    draws = spark.range(n_pairs).select("id", *[F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(side)), F.lit(n_points)).alias(side) for side in ("i", "j")]).filter("i != j")
    sides = [points.select(F.col("rank").alias(s), F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in "xyz"]) for s in ("i", "j")]
    joined = draws.withColumnRenamed("id", "draw").join(sides[0], "i").join(sides[1], "j")
    d2 = periodic_distance2([F.col(f"{c}_i") for c in "xyz"], [F.col(f"{c}_j") for c in "xyz"], box)
    return joined.select("draw", "id_i", "id_j", F.sqrt(d2).alias("distance"))


def finite_positive(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf")))
    return df


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as double, what is no number as NULL; rows that lack one are left out."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns}).dropna(subset=columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in order (by max_by, so that groups combine before they are shuffled)."""
    return keep_by(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_by(df, keys, order, F.min_by)


def keep_by(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def log_clip(df: DataFrame, value: str, share: float = 0.02) -> DataFrame:
    """log10 of the value, clipped from below at a quantile of the positive values."""
    floor = quantiles(df.filter(F.col(value) > 0), value, [share])[0]
    return df.withColumn("log_value", F.log10(F.greatest(F.col(value), F.lit(floor))))
