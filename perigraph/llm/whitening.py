"""Embedding whitening: a covariance by tiles of dimension pairs, its eigenvectors, and vectors projected on them.

Dimensions are cut into column blocks, rows into blocks of fixed size. A pair of column blocks is a tile; each row block
sends its column blocks to the tiles that need them, a task multiplies the two blocks of a tile and row block, and products
are summed by tile. Only the covariance itself, whose size is the dimension's square, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, small_side

#: Dimensions of a column block, and the power of two of a row block's rows: a task's group holds two blocks of 4,096 by 32.
TILE, ROW_BITS = 32, 12
#: Dimensions at most: the covariance and its eigenvectors are held by the driver.
MAX_DIMENSION = 2048
LONG = 2**63


@dataclass
class Whitening:
    """What was fitted: count, exact sums, covariance, all eigenvalues (falling), the first components (rows), and the
    largest absolute entry of the whitened fit rows' covariance minus the identity (None if some component has no spread)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray
    scales: np.ndarray
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        trace = float(np.trace(self.covariance))
        return [float(v) / trace if trace > 0 else None for v in self.values[: len(self.components)]]


def numbered(rows: DataFrame) -> DataFrame:
    """row (0, 1, ... without gaps) and x, so that row blocks are full however many tasks wrote the rows."""
    kept = materialize(rows.select(F.monotonically_increasing_id().alias("at"), "x"), "whitening-fit")
    task = F.shiftright("at", 33)
    runs = kept.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    runs = materialize(runs.select("task", (before - F.col("first")).alias("skip")), "whitening-runs")
    return kept.withColumn("task", task).join(small_side(runs, 24), "task").select((F.col("at") + F.col("skip")).alias("row"), "x")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, "<f8").tobytes()


def tile_blocks(rows: DataFrame, dimension: int, whole: list[int], rest: list[float], tile: int, row_bits: int) -> DataFrame:
    """Of rows (row, v): block, i, j, first, a packed run of the centred column block i and (unless i = j) one of j.

    The mean is taken off as a whole number first, which loses nothing where v is whole, then as the rest below one.
    """
    cuts = [slice(at, min(at + tile, dimension)) for at in range(0, dimension, tile)]
    kind = np.int64 if dict(rows.dtypes)["v"] == "array<bigint>" else float

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(0).to_numpy()
            centred = (matrix(batch.column(1), dimension) - np.array(whole, kind)).astype(float) - np.array(rest)
            starts = [0, *(np.flatnonzero(np.diff(numbers >> row_bits)) + 1), len(numbers)]
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for a, b in zip(starts, starts[1:], strict=False):
                blocks = [packed(centred[a:b, cut]) for cut in cuts]
                for i in range(len(cuts)):
                    for j in range(i, len(cuts)):
                        for values, x in zip(out, (int(numbers[a] >> row_bits), i, j, int(numbers[a]), blocks[i], blocks[j] if j > i else None), strict=True):
                            values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "i", "j", "first", "left", "right"])

    return rows.select("row", "v").mapInArrow(run, "block long, i int, j int, first long, left binary, right binary")


def tile_products(blocks: DataFrame, dimension: int, tile: int) -> DataFrame:
    """i, j, values: the product of a row block's two column blocks, row by row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("first").combine_chunks()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        wide = [min(tile, dimension - tile * k) for k in (i, j)]
        left = np.frombuffer(b"".join(table["left"].to_pylist()), "<f8").reshape(-1, wide[0])
        right = left if i == j else np.frombuffer(b"".join(table["right"].to_pylist()), "<f8").reshape(-1, wide[1])
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "values": pa.array([(left.T @ right).ravel()], pa.list_(pa.float64()))})

    return blocks.groupBy("block", "i", "j").applyInArrow(run, "i int, j int, values array<double>")


def covariance(rows: DataFrame, dimension: int, n: int, whole: list[int], rest: list[float], tile: int = TILE, row_bits: int = ROW_BITS) -> np.ndarray:
    """The covariance (divisor n) of rows (row, v) around whole + rest. row numbers rows without gaps."""
    products = tile_products(tile_blocks(rows, dimension, whole, rest, tile, row_bits), dimension, tile)
    summed = products.select("i", "j", F.posexplode("values").alias("at", "value")).groupBy("i", "j", "at").agg(F.sum("value").alias("value"))
    found = summed.toPandas()
    out, i, j = np.zeros((dimension, dimension)), found["i"].to_numpy(), found["j"].to_numpy()
    wide = np.minimum(tile, dimension - tile * j)
    a, b = i * tile + found["at"].to_numpy() // wide, j * tile + found["at"].to_numpy() % wide
    out[a, b] = found["value"].to_numpy() / n
    out[b, a] = out[a, b]
    return out


def projected(rows: DataFrame, model: Whitening, keep: list[str], deviation: bool = True) -> DataFrame:
    """keep, whitened and (if asked for) deviation of rows with the whole vectors x."""
    n, sums, components, scales, dimension = model.n, model.sums, model.components, model.scales, len(model.sums)
    whole, rest = [s // n for s in sums], [s % n / n for s in sums]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", whitened array<double>" + ", deviation long" * deviation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(len(keep)), dimension)
            centred = (x - np.array(whole)).astype(float) - np.array(rest)
            with np.errstate(divide="ignore", invalid="ignore"):
                values = centred @ components.T / scales
            flat = pa.array(values.ravel(), mask=~np.isfinite(values.ravel()))
            columns = [*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(components), pa.int32()), flat)]
            if deviation:
                most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
                if most * most * dimension < LONG:
                    exact = ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
                else:
                    exact = [e if e < LONG else None for e in ((n * x.astype(object) - total) ** 2).sum(axis=1).tolist()]
                columns.append(pa.array(exact, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "whitened", *["deviation"] * deviation])

    return rows.select(*keep, "x").mapInArrow(run, schema)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and x = floor(scale * c) of each entry, for vectors of one or more finite entries and no null."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fit = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).filter("size(v) > 0 and forall(v, c -> c is not null and c > double('-infinity') and c < double('infinity'))")
    return fit.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, tile: int = TILE, row_bits: int = ROW_BITS) -> tuple[DataFrame, Whitening | None]:
    """(id, whitened, deviation) of each usable vector, and the Whitening; no rows and None if there is none.

    Entries become x = floor(scale * c). The fit takes each distinct x vector once. whitened holds x - mean projected on the
    first components, over the root of their eigenvalues; null for a component without spread (an eigenvalue of 0 up to
    rounding). deviation is the sum over dimensions of (n x - sum)^2, exact, null where it fits no long. Vectors that are
    null, empty, or hold a null or non-finite entry have no row; repeated rows have a row each; vectors of several lengths,
    or beyond MAX_DIMENSION, are refused with an error. Entries beyond a long's range stop at its ends; extra columns are
    left aside. Components have their largest entry positive.
    """
    bound_batches(vectors.sparkSession)
    usable = whole_vectors(vectors, id_col, vector_col, scale)
    fit = numbered(usable.select("x").distinct())
    n, least, most = fit.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return usable.select("id", F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("long").alias("deviation")), None
    if least != most or most > MAX_DIMENSION:
        raise ValueError(f"vectors have {least} to {most} entries; one length up to {MAX_DIMENSION} is needed")
    summed = fit.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(20, 0)")).alias("s"))
    sums = [int(r["s"]) for r in summed.orderBy("at").collect()]
    whole, rest = [s // n for s in sums], [s % n / n for s in sums]
    found = covariance(fit.withColumnRenamed("x", "v"), most, n, whole, rest, tile, row_bits)
    values, axes = np.linalg.eigh(found)
    values, axes = values[::-1], axes[:, ::-1].T[:components]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    spread = values[: len(axes)] > max(values[0], 0) * most * np.finfo(float).eps
    scales = np.where(spread, np.sqrt(np.maximum(values[: len(axes)], 0)), 0.0)
    model = Whitening(n, sums, found, values, axes, scales)
    if spread.all():
        white = materialize(projected(fit, model, ["row"], False).select("row", F.col("whitened").alias("v")), "whitening-white")
        middle = white.select(F.posexplode("v").alias("at", "c")).groupBy("at").agg((F.sum("c") / n).alias("m")).orderBy("at").collect()
        model.identity_error = float(np.abs(covariance(white, len(axes), n, [0] * len(axes), [r["m"] for r in middle], tile, row_bits) - np.eye(len(axes))).max())
    return projected(usable, model, ["id"]), model
