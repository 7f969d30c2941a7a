"""Searches in a tree of cells against brute force, with dense cells, coincident points and empty regions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigraph.operators import tree

BOX = 10.0


def crowded(n, seed=1):
    """Half of all points in a cube of a thousandth of the box's side, some at one place, some on its far edge."""
    rng = np.random.default_rng(seed)
    xyz = rng.random((n, 3)) * BOX
    xyz[: n // 2] = 3.3 + rng.random((n // 2, 3)) * 0.01
    xyz[: n // 20] = xyz[0]
    xyz[-5:, 0] = [0.0, 1e-9, 9.9999999, 0.0, 5.0]
    return xyz


def table(spark, xyz, first=0):
    return spark.createDataFrame([(first + i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double").repartition(3)


def d2_of(a, b):
    gap = np.abs(a[:, None, :] - b[None, :, :])
    gap = np.minimum(gap, BOX - gap)
    gap = gap * gap
    return gap[..., 0] + gap[..., 1] + gap[..., 2]


@pytest.mark.parametrize(("n", "k", "leaf"), [(500, 5, 8), (500, 3, 64), (7, 3, 2), (6, 8, 4)])
def test_neighbours(spark, n, k, leaf):
    xyz = crowded(n)
    got = tree.tree_neighbours(table(spark, xyz), k, BOX, leaf)
    d2 = d2_of(xyz, xyz)
    np.fill_diagonal(d2, np.inf)
    want = {(i, r + 1): (int(j), float(np.sqrt(d2[i, j]))) for i in range(n) for r, j in enumerate(np.lexsort((np.arange(n), d2[i]))[: min(k, n - 1)])}
    assert {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in got.collect()} == want


def test_neighbours_of_many_at_one_place(spark):
    """Each place holds more points than are asked for, so all bounds are zero; leaves hold several places."""
    xyz, n, k = np.repeat(np.random.default_rng(4).random((60, 3)) * BOX, 7, axis=0), 420, 4
    got = {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in tree.tree_neighbours(table(spark, xyz), k, BOX, 64).collect()}
    others = [[j for j in range(7 * (i // 7), 7 * (i // 7) + 7) if j != i] for i in range(n)]
    assert got == {(i, r + 1): (others[i][r], 0.0) for i in range(n) for r in range(k)}


@pytest.mark.parametrize(("radius", "leaf"), [(0.004, 8), (0.9, 8), (3.2, 64)])
def test_pairs(spark, radius, leaf):
    """Each pair once in both directions, across the box's faces, coincident points and pairs at the very radius included."""
    xyz = np.concatenate([crowded(400), [[1.0, 2.0, 3.0], [1.0 + radius, 2.0, 3.0]]])
    d = np.sqrt(d2_of(xyz, xyz))
    np.fill_diagonal(d, np.inf)
    radius = float(d[400, 401])
    got = [tuple(r) for r in tree.tree_pairs(table(spark, xyz), radius, BOX, leaf).collect()]
    assert sorted(got) == [(int(i), int(j), float(d[i, j])) for i, j in zip(*np.nonzero(d <= radius), strict=True)]


@pytest.mark.parametrize("leaf", [4, 64])
def test_counts(spark, leaf):
    xyz = crowded(400)
    others = np.concatenate([xyz[::7], np.random.default_rng(5).random((20, 3)) * BOX])
    centres = spark.createDataFrame([(7 * i if 7 * i < 400 else 1000 + i, *map(float, p)) for i, p in enumerate(others)], "id long, x double, y double, z double")
    radii = [0.002, 0.01, 0.7, 1.5, 3.0, 4.9]
    d2 = d2_of(others, xyz)
    for i in range(len(xyz[::7])):
        d2[i, 7 * i] = np.inf
    want = {(7 * i if 7 * i < 400 else 1000 + i, k): int((d2[i] <= r * r).sum()) for i in range(len(others)) for k, r in enumerate(radii)}
    got = tree.tree_counts(centres, table(spark, xyz), radii, BOX, leaf)
    assert {(r["center"], r["r_index"]): r["count"] for r in got.collect()} == want
    with pytest.raises(ValueError, match="half the box"):
        tree.tree_counts(centres, centres, [1.0, 5.0], BOX)


def test_leaves_are_bounded(spark):
    """Half of all points in one cell of an even grid: no leaf holds more than it may, unless points coincide."""
    n, leaf = 4000, 32
    built = tree.cell_tree(table(spark, crowded(n)), BOX, leaf)
    sizes = [r["n"] for r in built.leaves.select((F.length("ids") / 8).cast("int").alias("n")).collect()]
    assert sum(sizes) == n and sorted(sizes)[-10] <= leaf and max(sizes) <= 2 * leaf  # parts of coincident points by hash
    assert built.cells.filter("leaf").agg(F.sum("n")).first()[0] == n
    assert built.cells.filter(f"leaf and n > {leaf}").filter(f"depth < {tree.BITS}").isEmpty()


def test_whole_cells_are_counted(spark, monkeypatch):
    """Of even points, a good part of what lies within a radius is counted by cells and never compared."""
    seen = []
    real = tree.descend
    monkeypatch.setattr(tree, "descend", lambda *a: (seen.append(out := real(*a)), out)[1])
    xyz = np.random.default_rng(3).random((4000, 3)) * BOX
    points = table(spark, xyz)
    got = tree.tree_counts(points, points, [4.0], BOX, 8).agg(F.sum("count")).first()[0]
    assert got == int((d2_of(xyz, xyz) <= 16).sum()) - 4000
    sizes = tree.cell_tree(points, BOX, 8).cells.filter("leaf").select(F.col("mx").alias("ax"), F.col("my").alias("ay"), F.col("mz").alias("az"), F.col("n").alias("m"))
    whole = seen[0][1].filter("low = 0").join(sizes, ["ax", "ay", "az"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert 0 < whole < got
