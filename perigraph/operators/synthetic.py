"""Synthetic periodic controls: Gaussian fields, displaced and biased catalogues."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_normal, hash_uniform, wrap
from ..session import BROADCAST_BYTES
from .heatkernel import interpolate_at
from .spectrum import all_cells, frequency, transform

#: Bytes that a cell of a mesh and its corners' values take in a broadcast table.
CELL_BYTES = 160


def white_noise(spark: SparkSession, m: int, seed: int = 0) -> DataFrame:
    return all_cells(spark, m).withColumn("v", hash_normal(F.lit(seed), F.col("ix"), F.col("iy"), F.col("iz")))


def mode_powers(table: DataFrame, m: int, box: float, scale: str = "log") -> DataFrame:
    """n2 and power of every shell of a mesh, interpolated in a spectrum (k, p), zero outside it; negative power is zero."""
    spark = table.sparkSession
    shells = all_cells(spark, m).select(F.expr(f"pow({frequency('ix', m)}, 2) + pow({frequency('iy', m)}, 2) + pow({frequency('iz', m)}, 2)").cast("int").alias("n2")).filter("n2 > 0").distinct()
    at = shells.withColumn("at", 2 * math.pi / box * F.sqrt("n2"))
    return interpolate_at(at, table, "k", "p", scale, clamp=False).select("n2", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)).alias("p"))


def coloured_modes(noise: DataFrame, powers: DataFrame, m: int, box: float) -> DataFrame:
    """Modes of the noise times sqrt(power / cell volume)."""
    modes = transform(noise, m)
    n2 = F.expr(f"pow({frequency('ix', m)}, 2) + pow({frequency('iy', m)}, 2) + pow({frequency('iz', m)}, 2)").cast("int")
    joined = modes.withColumn("n2", n2).join(powers, "n2", "left")
    amplitude = F.sqrt(F.coalesce("p", F.lit(0.0)) / (box / m) ** 3)
    return joined.select("ix", "iy", "iz", (F.col("re") * amplitude).alias("re"), (F.col("im") * amplitude).alias("im"))


def real_part(field: DataFrame) -> DataFrame:
    return field.select("ix", "iy", "iz", F.col("re").alias("v"))


def density_field(modes: DataFrame, m: int) -> DataFrame:
    return real_part(transform(modes, m, inverse=True))


def displacement_modes(modes: DataFrame, axis: str, m: int, box: float) -> DataFrame:
    """i k / k^2 times the density modes along an axis; modes at the highest frequency along it are left out, as they have no sign."""
    n = {c: frequency(f"i{c}", m) for c in "xyz"}
    n2 = f"({n['x']} * {n['x']} + {n['y']} * {n['y']} + {n['z']} * {n['z']})"
    factor = F.expr(f"case when {n2} = 0 or {n[axis]} = {m // 2} and {m} % 2 = 0 then 0D else {box / (2 * math.pi)}D * {n[axis]} / {n2} end")
    return modes.select("ix", "iy", "iz", (-F.col("im") * factor).alias("re"), (F.col("re") * factor).alias("im"))


def density_from_displacement(fields: dict[str, DataFrame], m: int, box: float) -> DataFrame:
    """Density recovered as minus the divergence of a displacement (fields by axis), in Fourier space."""
    total = None
    for axis, field in fields.items():
        k = F.expr(f"{2 * math.pi / box}D * {frequency(f'i{axis}', m)}")
        part = transform(field, m).select("ix", "iy", "iz", (k * F.col("im")).alias("re"), (-k * F.col("re")).alias("im"))
        total = part if total is None else total.unionByName(part)
    return density_field(total.groupBy("ix", "iy", "iz").agg(F.sum("re").alias("re"), F.sum("im").alias("im")), m)


def mesh_at_points(points: DataFrame, field: DataFrame, m: int, box: float) -> DataFrame:
    """id, value: the mesh (values at cell corners) interpolated linearly between its eight corners around each point.

    Cells gather their corners, so a point meets one row. A small mesh is broadcast; the points never are, whatever size Spark
    takes them for.
    """
    around = F.array(*[F.struct(F.lit(o).alias("o"), *[F.lit(o >> b & 1).alias(f"o{c}") for b, c in enumerate("xyz")]) for o in range(8)])
    spread = field.withColumn("corner", F.explode(around))
    keyed = spread.select("v", "corner.o", *[F.pmod(F.col(f"i{c}") - F.col(f"corner.o{c}"), F.lit(m)).alias(f"i{c}") for c in "xyz"])
    cells = keyed.groupBy("ix", "iy", "iz").agg(*[F.sum(F.when(F.col("o") == o, F.col("v"))).alias(f"v{o}") for o in range(8)])
    cells = F.broadcast(cells) if m**3 * CELL_BYTES <= BROADCAST_BYTES else cells.hint("merge")
    spots = points
    for c in "xyz":
        u = F.col(c).cast("double") / (box / m)
        spots = spots.withColumn(f"f{c}", u - F.floor(u)).withColumn(f"i{c}", F.pmod(F.floor(u).cast("int"), F.lit(m)))
    value = F.lit(0.0)
    for o in range(8):
        weight = F.lit(1.0)
        for b, c in enumerate("xyz"):
            weight = weight * (F.col(f"f{c}") if o >> b & 1 else 1 - F.col(f"f{c}"))
        value = value + F.coalesce(weight * F.col(f"v{o}"), F.lit(0.0))
    known = F.coalesce(*[F.col(f"v{o}") for o in range(8)]).isNotNull()
    met = spots.select("id", *[f"{n}{c}" for n in "if" for c in "xyz"]).join(cells, ["ix", "iy", "iz"])
    return met.groupBy("id").agg(F.sum(F.when(known, value)).alias("value"))


def uniform_points(spark: SparkSession, n: int, box: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", *[(box * hash_uniform(F.lit(seed), F.col("id"), F.lit(c))).alias(c) for c in "xyz"])


def displaced(points: DataFrame, fields: dict[str, DataFrame], m: int, box: float) -> DataFrame:
    """The points moved by a displacement field (by axis) and wrapped."""
    out = points
    for axis, field in fields.items():
        out = out.join(mesh_at_points(points, field, m, box).withColumnRenamed("value", f"_d{axis}"), "id")
    return out.select("id", *[wrap(F.col(c) + F.col(f"_d{c}"), box).alias(c) for c in "xyz"])


def biased_weights(field: DataFrame, b: float) -> DataFrame:
    """p: normalised lognormal weights exp(b v) of the cells."""
    out = field.withColumn("_w", F.exp(b * F.col("v")))
    total = out.agg(F.sum("_w").alias("_t"))
    return out.crossJoin(F.broadcast(total)).select("ix", "iy", "iz", (F.col("_w") / F.col("_t")).alias("p"))


def cumulative(weights: DataFrame, cells: int, slices: int = 64) -> DataFrame:
    """low and high: the running sum of p in cell order, in two steps, so that no task orders all cells."""
    ordered = weights.withColumn("slice", F.expr(f"cast(cell * {slices} div {cells} as int)"))
    base = ordered.groupBy("slice").agg(F.sum("p").alias("_s")).withColumn("_base", F.expr("coalesce(sum(_s) over (order by slice rows between unbounded preceding and 1 preceding), 0D)")).drop("_s")
    out = ordered.withColumn("_in", F.expr("sum(p) over (partition by slice order by cell rows between unbounded preceding and current row)")).join(F.broadcast(base), "slice")
    return out.withColumn("high", F.col("_base") + F.col("_in")).withColumn("low", F.col("high") - F.col("p")).drop("_base", "_in", "slice")


def sampled_cells(weights: DataFrame, n: int, m: int, seed: int = 0) -> DataFrame:
    """n points in cells drawn by their weights (multinomial at fixed n): id and cell indices.

    Draws and cells meet by equal slices of the cumulative weight: a cell is copied to each slice that it touches.
    """
    spark, slices = weights.sparkSession, m * m
    cells = cumulative(weights.withColumn("cell", F.expr(f"(ix * {m} + iy) * {m} + iz")), m**3)
    cells = cells.withColumn("bucket", F.explode(F.expr(f"sequence(cast(floor(low * {slices}) as int), cast(floor(least(high, 1D) * {slices}) as int))")))
    draws = spark.range(n).withColumn("u", hash_uniform(F.lit(seed), F.col("id"), F.lit("cell"))).withColumn("bucket", F.floor(F.col("u") * slices).cast("int"))
    return draws.join(cells, "bucket").filter("u >= low and u < high").select("id", "ix", "iy", "iz")


def jittered(cells: DataFrame, m: int, box: float, seed: int = 0) -> DataFrame:
    """A uniform place within each point's cell."""
    side = box / m
    return cells.select("id", *[((F.col(f"i{c}") + hash_uniform(F.lit(seed), F.col("id"), F.lit(f"jitter {c}"))) * side).alias(c) for c in "xyz"])


def field_statistics(field: DataFrame) -> DataFrame:
    return field.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def effective_cells(weights: DataFrame) -> DataFrame:
    """1 / sum of p^2."""
    return weights.agg((1 / F.sum(F.col("p") * F.col("p"))).alias("n_effective"))


def as_float(x: Column, box: float) -> Column:
    """x in single precision, still below the box."""
    y = x.cast("float")
    return F.when(y >= F.lit(box).cast("float"), F.lit(0.0).cast("float")).otherwise(y)
