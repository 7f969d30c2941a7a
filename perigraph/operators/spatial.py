"""Periodic spatial joins: nearest neighbours, radius graphs, counts in spheres.

Searches go by a tree of cells, however dense the points are. In a grid (close_pairs), points are copied as ghosts into the
cells around their own, so that a cell's join partners and any ranking of them need one shuffle by cell.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cell_index, periodic_distance2
from ..session import require
from .tree import tree_counts, tree_neighbours, tree_pairs

CELL = ["cx", "cy", "cz"]


def with_cells(points: DataFrame, box: float, cells: int) -> DataFrame:
    return points.withColumns({f"c{c}": cell_index(F.col(c).cast("double"), box, cells) for c in "xyz"})


def ghosts(points: DataFrame, box: float, cells: int, span: int = 1) -> DataFrame:
    """Each point once for every cell within span of its own: id, coordinates and that cell."""
    steps = sorted({s % cells for s in range(-span, span + 1)})
    shifts = F.array(*[F.struct(*[F.lit(s).alias(f"s{c}") for c, s in zip("xyz", t, strict=True)]) for t in product(steps, repeat=3)])
    spread = with_cells(points, box, cells).withColumn("shift", F.explode(shifts))
    return spread.withColumns({f"c{c}": F.pmod(F.col(f"c{c}") + F.col(f"shift.s{c}"), F.lit(cells)) for c in "xyz"}).drop("shift")


def close_pairs(sources: DataFrame, points: DataFrame, box: float, cells: int, span: int = 1, spread: str = "points") -> DataFrame:
    """src, dst, d2 and the cell where they met for all pairs of different ids within span cells.

    The side named by spread is copied to the cells around: points, so that all pairs of a source meet in its own cell;
    or sources, where these are few and the span is wide.
    """
    left = ghosts(sources, box, cells, span) if spread == "sources" else with_cells(sources, box, cells)
    right = ghosts(points, box, cells, span) if spread == "points" else with_cells(points, box, cells)
    left = left.select(*CELL, F.col("id").alias("src"), *[F.col(c).cast("double").alias(f"{c}_src") for c in "xyz"])
    right = right.select(*CELL, F.col("id").alias("dst"), *[F.col(c).cast("double").alias(f"{c}_dst") for c in "xyz"])
    d2 = periodic_distance2([F.col(f"{c}_src") for c in "xyz"], [F.col(f"{c}_dst") for c in "xyz"], box)
    return left.join(right, CELL).filter("src != dst").select(*CELL, "src", "dst", d2.alias("d2"))


def nearest_neighbours(points: DataFrame, k: int, box: float, cells: int | None = None) -> DataFrame:
    """src, rank (from 1), dst, dist: the k nearest others of each point (id, x, y, z), ties by id.

    Searches in a tree of cells, see tree_neighbours, however dense the points are. With cells given, raises where a point
    lacks k neighbours nearer than a cell of a grid of so many a side is wide, as a search in that grid could miss one.
    """
    table = tree_neighbours(points, k, box)
    if cells is not None:
        require_cells(table, points, k, box, cells)
    return table


def require_cells(neighbours: DataFrame, points: DataFrame, k: int, box: float, cells: int) -> None:
    """Raises where some point's k-th neighbour is not nearer than a cell of a grid of so many a side is wide."""
    whole = neighbours.filter((F.col("rank") == k) & (F.col("dist") < box / cells)).select(F.col("src").alias("id"))
    require(points.join(whole, "id", "left_anti").isEmpty(), f"a point has fewer than {k} neighbours within a cell of {box / cells:.6g}")


def target_radius(n: int, degree: float, box: float) -> float:
    """Radius at which points of this number have the degree on average."""
    return (3 * degree / (4 * math.pi * n / box**3)) ** (1 / 3)


def radius_edges(points: DataFrame, radius: float, box: float) -> DataFrame:
    """src, dst, dist of all pairs within radius (inclusive), both directions, by a tree of cells, see tree_pairs."""
    require(math.floor(box / radius * (1 - 1e-12)) >= 3, f"radius {radius} is too large for a box of {box}")
    return tree_pairs(points, radius, box)


def counts_in_spheres(centres: DataFrame, points: DataFrame, radii: list[float], box: float, cells: int) -> DataFrame:
    """center, r_index, radius, count: points within each radius (inclusive) of each centre, itself left out.

    Every centre has a row for every radius, also where the count is zero. Raises where a grid of so many cells a side
    would be spanned by the largest radius; the counting itself goes by a tree of cells, see tree_counts.
    """
    span = math.ceil(radii[-1] / (box / cells))
    require(2 * span + 1 <= cells, "the largest radius spans the whole grid")
    require(radii[-1] < box / 2, "the largest radius is over half the box")
    return tree_counts(centres, points, radii, box)
