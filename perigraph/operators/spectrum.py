"""Power spectra of point sets on periodic meshes.

Meshes are long tables (ix, iy, iz, v). The transform works on planes: one shuffle brings a plane of two axes together,
a second one the third axis, so a mesh of m^3 cells is m tasks of m^2 cells each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sinc
from ..session import BROADCAST_BYTES


def all_cells(spark: SparkSession, m: int) -> DataFrame:
    return spark.range(m**3).select((F.col("id") / (m * m)).cast("int").alias("ix"), F.expr(f"cast((id div {m}) % {m} as int)").alias("iy"), F.expr(f"cast(id % {m} as int)").alias("iz"))


def nearest_grid_counts(points: DataFrame, box: float, m: int) -> DataFrame:
    """Points per mesh cell that has any, coordinates wrapped."""
    cell = {f"i{c}": F.pmod(F.floor(F.pmod(F.col(c).cast("double"), F.lit(float(box))) / (box / m)).cast("int"), F.lit(m)) for c in "xyz"}
    return points.groupBy(*[e.alias(n) for n, e in cell.items()]).agg(F.count(F.lit(1)).alias("n"))


def density_contrast(counts: DataFrame, m: int, total: int) -> DataFrame:
    """v = n / mean - 1 for every cell."""
    mean = total / m**3
    return all_cells(counts.sparkSession, m).join(counts, ["ix", "iy", "iz"], "left").select("ix", "iy", "iz", (F.coalesce("n", F.lit(0)) / mean - 1).alias("v"))


def transform(field: DataFrame, m: int, inverse: bool = False) -> DataFrame:
    """The discrete Fourier transform of columns re and im (or v): ix, iy, iz, re, im, indices now frequencies 0..m-1."""
    if "v" in field.columns:
        field = field.select("ix", "iy", "iz", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    forward = np.fft.ifft if inverse else np.fft.fft

    def along(axes: tuple[int, ...], fixed: str, rest: tuple[str, str]):
        def run(table: pa.Table) -> pa.Table:
            i, j = (table.column(c).to_numpy() for c in rest)
            plane = np.zeros((m, m), complex)
            plane[i, j] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
            for axis in axes:
                plane = forward(plane, axis=axis)
            i, j = (x.ravel().astype(np.int32) for x in np.indices((m, m)))
            own = np.full(m * m, table.column(fixed)[0].as_py(), np.int32)
            values = {fixed: own, rest[0]: i, rest[1]: j, "re": plane.real.ravel(), "im": plane.imag.ravel()}
            return pa.table({n: values[n] for n in ("ix", "iy", "iz", "re", "im")})

        return run

    schema = "ix int, iy int, iz int, re double, im double"
    planes = field.groupBy("iz").applyInArrow(along((0, 1), "iz", ("ix", "iy")), schema)
    return planes.groupBy("ix").applyInArrow(along((1,), "ix", ("iy", "iz")), schema)


#: Values that a task of real_transform holds at most, unless one line is longer.
PENCIL = 1 << 16


def real_transform(field: DataFrame, m: int, pencil: int = PENCIL) -> DataFrame:
    """The transform of a real field v, iz only up to m / 2, as the rest mirrors it: half the rows of transform.

    Lines along one axis after the other, in bundles of so many values: a task never holds a plane, and the mesh's side is
    bounded by a line alone.
    """
    half = m // 2 + 1

    def along(axis: str, first: bool):
        others = [c for c in ("ix", "iy", "iz") if c != axis]

        def run(table: pa.Table) -> pa.Table:
            a, b, at = (table.column(c).to_numpy().astype(np.int64) for c in (*others, axis))
            keys, line = np.unique(a * m + b, return_inverse=True)
            values = np.zeros((len(keys), m), float if first else complex)
            values[line, at] = table.column("v").to_numpy() if first else table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
            out = np.fft.rfft(values, axis=1) if first else np.fft.fft(values, axis=1)
            n = out.shape[1]
            found = {others[0]: np.repeat(keys // m, n), others[1]: np.repeat(keys % m, n), axis: np.tile(np.arange(n), len(keys))}
            return pa.table({**{c: pa.array(found[c].astype(np.int32)) for c in ("ix", "iy", "iz")}, "re": out.real.ravel(), "im": out.imag.ravel()})

        return run

    schema, out = "ix int, iy int, iz int, re double, im double", field.select("ix", "iy", "iz", F.col("v").cast("double").alias("v"))
    for axis in ("iz", "iy", "ix"):
        a, b = (c for c in ("ix", "iy", "iz") if c != axis)
        wide = half if b == "iz" else m
        bundle = F.expr(f"({a} * {wide}L + {b}) div {max(1, pencil // m)}").alias("bundle")
        out = out.groupBy(bundle).applyInArrow(along(axis, axis == "iz"), schema)
    return out


def completed(modes: DataFrame, m: int) -> DataFrame:
    """All modes from those that real_transform gives."""
    mirrored = modes.filter(f"iz > 0 and 2 * iz < {m}").select(*[F.expr(f"cast(({m} - {c}) % {m} as int)").alias(c) for c in ("ix", "iy", "iz")], "re", (-F.col("im")).alias("im"))
    return modes.unionByName(mirrored)


#: Bytes of a row of phases: two indices, cosine, sine.
PHASE_BYTES = 24


def transform_by_sums(field: DataFrame, m: int) -> DataFrame:
    """The same forward transform by three joins with a table of phases and three aggregations; for small meshes."""
    angle = F.lit(-2 * math.pi / m) * F.col("k") * F.col("i")
    spark = field.sparkSession
    phases = spark.range(m * m).select(F.expr(f"cast(id div {m} as int)").alias("k"), F.expr(f"cast(id % {m} as int)").alias("i")).select("k", "i", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    out = field.select("ix", "iy", "iz", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    for axis in ("ix", "iy", "iz"):
        rest = [a for a in ("ix", "iy", "iz") if a != axis]
        along = phases.withColumnRenamed("i", axis)
        joined = out.join(F.broadcast(along) if m * m * PHASE_BYTES <= BROADCAST_BYTES else along, axis)
        out = joined.groupBy(*rest, "k").agg(F.sum(F.col("re") * F.col("c") - F.col("im") * F.col("s")).alias("re"), F.sum(F.col("re") * F.col("s") + F.col("im") * F.col("c")).alias("im")).withColumnRenamed("k", axis)
    return out.select("ix", "iy", "iz", "re", "im")


def frequency(index: str, m: int) -> str:
    """The signed whole wave number of an index, as SQL text."""
    return f"(case when {index} <= {m // 2} then {index} else {index} - {m} end)"


def shell_spectrum(modes: DataFrame, box: float, m: int, n_points: int, k_max: float | None = None, window: bool = True, half: bool = False) -> DataFrame:
    """Per shell of whole n2 = nx^2 + ny^2 + nz^2 > 0: n2, k, p_raw, p_shot, p_sub, n_modes.

    Power is |v|^2 V / N^2, corrected for the nearest-grid window. Each mode of a complete transform counts once; of a half one
    (real_transform), modes whose mirror is left out count twice.
    """
    out = modes.withColumns({f"n{c}": F.expr(frequency(f"i{c}", m)) for c in "xyz"}).withColumn("n2", F.expr("nx * nx + ny * ny + nz * nz")).filter("n2 > 0")
    w = sinc(F.col("nx") / float(m)) * sinc(F.col("ny") / float(m)) * sinc(F.col("nz") / float(m)) if window else F.lit(1.0)
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * (box**3 / float(m) ** 6) / (w * w)
    times = F.when((F.col("iz") > 0) & (2 * F.col("iz") < m), 2).otherwise(1) if half else F.lit(1)
    shells = out.groupBy("n2").agg((F.sum(power * times) / F.sum(times)).alias("p_raw"), F.sum(times).cast("long").alias("n_modes"))
    shot = box**3 / n_points if n_points else 0.0
    shells = shells.select("n2", (2 * math.pi / box * F.sqrt("n2")).alias("k"), "p_raw", F.lit(shot).alias("p_shot"), (F.col("p_raw") - shot).alias("p_sub"), "n_modes")
    return shells if k_max is None else shells.filter(F.col("k") <= k_max)


def linear_bins(shells: DataFrame, dk: float) -> DataFrame:
    """Shells pooled in bins of k: mean k and power over modes."""
    out = shells.groupBy(F.floor(F.col("k") / dk).alias("bin")).agg(F.sum("n_modes").alias("n_modes"), F.sum(F.col("k") * F.col("n_modes")).alias("sk"), F.sum(F.col("p_sub") * F.col("n_modes")).alias("sp"))
    return out.select("bin", "n_modes", (F.col("sk") / F.col("n_modes")).alias("k_mean"), (F.col("sp") / F.col("n_modes")).alias("p_mean"))


def shell_geometry(spark: SparkSession, reach: int) -> DataFrame:
    """n2 and n_modes of all whole vectors within reach along each axis (up to reach^2, where shells are complete)."""
    side = spark.range(-reach, reach + 1)
    x, y, z = (side.withColumnRenamed("id", c) for c in ("a", "b", "c"))
    grid = x.crossJoin(y).crossJoin(z)  # the set of vectors itself
    return grid.select(F.expr("a * a + b * b + c * c").alias("n2")).filter((F.col("n2") > 0) & (F.col("n2") <= reach * reach)).groupBy("n2").agg(F.count(F.lit(1)).alias("n_modes"))


def compare_shells(measured: DataFrame, target: DataFrame) -> DataFrame:
    """Ratio of measured power to a target (n2, p) on the shells that both have."""
    return measured.join(target.withColumnRenamed("p", "p_target"), "n2").select("n2", "k", "n_modes", (F.col("p_raw") / F.col("p_target")).alias("ratio"))
