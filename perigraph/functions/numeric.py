"""Grids, interpolation and gradients."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .windows import over


def positive(x: Column) -> Column:
    """x where it is finite and above zero, else NULL."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x), 1 at zero."""
    return F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))


def linear_grid(first: float, last: float, n: int) -> list[float]:
    """n values with exact end points."""
    step = (last - first) / (n - 1) if n > 1 else 0.0
    return [*[first + step * i for i in range(n - 1)], float(last)]


def geometric_grid(first: float, last: float, n: int) -> list[float]:
    """n values in equal ratios, with exact end points. From zero the ratio is infinite, and the values between are NaN."""
    ratio = ((last / first) ** (1.0 / (n - 1)) if first else math.inf) if n > 1 else 1.0
    return [float(first), *[first * ratio**i for i in range(1, n - 1)], float(last)] if n > 1 else [float(first)]


def linear_interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The line through two points at x; y0 where they coincide."""
    return F.when(x1 == x0, y0).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))


def log_interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The power law through two points at x; y0 where they coincide."""
    return F.when(x1 == x0, y0).otherwise(F.exp(F.ln(y0) + (F.ln(x) - F.ln(x0)) * (F.ln(y1) - F.ln(y0)) / (F.ln(x1) - F.ln(x0))))


def three_point_gradient(y: str, x: str, keys: list[str], edge_order: int = 2) -> Column:
    """dy/dx on an uneven grid: second order inside, one-sided at the ends; needs three points at edge_order 2.

    y and x are names of columns in one row per grid point.
    """
    w = over(keys, x)
    before, after = f"({x} - lag({x}) {w})", f"(lead({x}) {w} - {x})"
    inside = f"""({before} * {before} * lead({y}) {w} - {after} * {after} * lag({y}) {w} + ({after} * {after} - {before} * {before}) * {y})
        / ({before} * {after} * ({before} + {after}))"""
    if edge_order == 1:
        first, last = f"(lead({y}) {w} - {y}) / {after}", f"({y} - lag({y}) {w}) / {before}"
    else:

        def one_sided(step: str, sign: str) -> str:
            h1, h2 = f"abs({step}({x}) {w} - {x})", f"abs({step}({x}, 2) {w} - {step}({x}) {w})"
            return f"""{sign}(-(2 * {h1} + {h2}) / ({h1} * ({h1} + {h2})) * {y} + ({h1} + {h2}) / ({h1} * {h2}) * {step}({y}) {w}
                - {h1} / ({h2} * ({h1} + {h2})) * {step}({y}, 2) {w})"""

        first, last = one_sided("lead", ""), one_sided("lag", "-")
    return F.expr(f"case when lag({x}) {w} is null then {first} when lead({x}) {w} is null then {last} else {inside} end")
