"""Periodic geometry in a cubic box."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(x: Column, box: float) -> Column:
    """Into [0, box), also when rounding gives box itself."""
    inside = F.pmod(x, F.lit(float(box)))
    return F.when(inside >= box, 0.0).otherwise(inside)


def minimum_image(delta: Column, box: float) -> Column:
    """The signed difference to the nearest periodic image."""
    return delta - float(box) * F.rint(delta / float(box))


def periodic_distance2(a: list[Column], b: list[Column], box: float) -> Column:
    """Squared distance to the nearest image, coordinates added in the order given."""
    total = None
    for x, y in zip(a, b, strict=True):
        gap = F.abs(x - y)
        gap = F.least(gap, float(box) - gap)
        total = gap * gap if total is None else total + gap * gap
    return total


def cell_index(x: Column, box: float, cells: int) -> Column:
    """The cell of a coordinate in [0, box)."""
    return F.least(F.floor(x / (float(box) / cells)).cast("int"), F.lit(cells - 1))
