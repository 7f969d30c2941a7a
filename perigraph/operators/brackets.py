"""The rows of a curve on both sides of given places, for curves and places of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import over
from ..session import materialize

#: Curves of at most so many rows are sent to the places, each of which is held against all of them.
SHORT_CURVE = 1024


def bracketed(places: DataFrame, at: str, curve: DataFrame, x: str, y: str) -> DataFrame:
    """places with x0, y0 (the curve's last row at or before at) and x1, y1 (its first row after), NULL where there is none.

    Of rows at one x the largest y counts; rows without x are left out; a place of NULL gets NULLs. A short curve is
    broadcast after it has been counted. A longer one is merged with the different places in value order: ranges of values
    in tasks of their own, each range told the nearest rows of the ranges around it. So neither is ordered in one task,
    and a place that many rows share travels once before the rows meet it.
    """
    knots = materialize(curve.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.max(F.col(y).cast("double")).alias("y")), "curve")
    if knots.count() <= SHORT_CURVE:
        w = over([], "v")
        pieces = knots.select(F.col("v").alias("x0"), F.col("y").alias("y0"), F.expr(f"lead(v) {w}").alias("x1"), F.expr(f"lead(y) {w}").alias("y1"))
        first = knots.agg(F.min("v").alias("x1"), F.min_by("y", "v").alias("y1")).filter("x1 is not null")
        pieces = pieces.unionByName(first.select(F.lit(None).cast("double").alias("x0"), F.lit(None).cast("double").alias("y0"), "x1", "y1"))
        here = (F.col("x0").isNull() | (F.col(at) >= F.col("x0"))) & (F.col("x1").isNull() | (F.col(at) < F.col("x1")))
        return places.join(F.broadcast(pieces), F.col(at).isNotNull() & here, "left")

    spark = places.sparkSession
    known = knots.select("v", F.struct("v", "y").alias("knot"))
    asked = places.filter(F.col(at).isNotNull()).select(F.col(at).cast("double").alias("v")).distinct()
    merged = known.unionByName(asked.select("v", F.lit(None).cast(known.schema["knot"].dataType).alias("knot")))
    merged = merged.groupBy("v").agg(F.max("knot").alias("knot"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = materialize(merged.repartitionByRange(ranges, "v").withColumn("slice", F.spark_partition_id()), "ranges")

    up, down = over(["slice"], "v", "unbounded preceding and current row"), over(["slice"], "v desc", "unbounded preceding and 1 preceding")
    inside = merged.select("slice", "v", F.expr(f"last(knot, true) {up}").alias("low"), F.expr(f"last(knot, true) {down}").alias("high"))
    ends = merged.groupBy("slice").agg(F.min("knot").alias("least"), F.max("knot").alias("most"))  # a row per range
    other = "unbounded preceding and 1 preceding"
    ends = ends.select("slice", F.expr(f"last(most, true) {over([], 'slice', other)}").alias("below"), F.expr(f"last(least, true) {over([], 'slice desc', other)}").alias("above"))
    low, high = F.coalesce("low", "below"), F.coalesce("high", "above")
    found = inside.join(F.broadcast(ends), "slice").select(F.col("v").alias("_v"), low["v"].alias("x0"), low["y"].alias("y0"), high["v"].alias("x1"), high["y"].alias("y1"))
    return places.join(found, F.col(at).cast("double") == F.col("_v"), "left").drop("_v")
