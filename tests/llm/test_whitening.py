"""Whitening against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigraph.llm import queries, whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("x")).withColumn("x", F.lit(1)).withColumn("id", F.lit(None).cast("string"))


def brute(rows, components=4):
    """{(vec_id, component): (n, deviation, whitened up to sign, explained)} of distinct rows."""
    whole = {}
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            whole.setdefault(i, []).append([math.floor(256 * float(np.float32(c))) for c in v])
    fit = sorted({tuple(x) for xs in whole.values() for x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, xs in whole.items():
        for x in xs:
            for k in range(min(components, len(x))):
                flat = (np.array(x, float) - np.array(sums) / n) @ axes[:, k] / math.sqrt(values[k])
                out.setdefault((i, k + 1), []).append((n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), abs(flat), values[k] / values.sum()))
    return {k: sorted(v) for k, v in out.items()}


def found(df):
    out = {}
    for r in df.collect():
        assert r["identity_error"] <= 1e-9
        out.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
    return {k: sorted(v) for k, v in out.items()}


def close(got, want):
    assert got.keys() == want.keys()
    for k, rows in want.items():
        assert len(got[k]) == len(rows)
        for a, b in zip(got[k], rows, strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-7, abs=1e-7) and a[3] == pytest.approx(b[3], rel=1e-9)


def vectors(n, dimension, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dimension)) @ rng.normal(size=(dimension, dimension)) + 40
    return [(i, [float(c) for c in row]) for i, row in enumerate(v.astype(np.float32))]


@pytest.mark.parametrize(("dimension", "tile", "bits"), [(7, 3, 4), (8, 32, 12), (2, 1, 2), (33, 16, 5)])
def test_against_numpy(spark, dimension, tile, bits):
    """Tiles that do not divide the dimension, row blocks that do not divide the rows, and many copies of one vector."""
    rows = vectors(300, dimension)
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(5, rows[9][1]), (None, rows[3][1])]
    odd = [(2000, None), (2001, []), (2002, [None] * dimension), (2003, [math.nan] * dimension), (2004, [math.inf] + [0.0] * (dimension - 1)), (2005, [0.0] * (dimension - 1) + [-math.inf])]
    got = queries.whitened_columns(*whitening.whiten(table(spark, rows + odd).repartition(4), tile=tile, row_bits=bits))
    close(found(got), brute(rows))


def test_covariance_is_that_of_all_rows(spark):
    rows = vectors(700, 10, 3)
    _, model = whitening.whiten(table(spark, rows).repartition(6), tile=4, row_bits=3)
    x = np.unique(np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)), axis=0)
    assert np.allclose(model.covariance, np.cov(x.T, bias=True), rtol=1e-12)
    assert model.sums == x.sum(axis=0).astype(int).tolist() and model.n == len(x)
    assert np.allclose(model.components @ model.components.T, np.eye(4), atol=1e-12)


def test_row_blocks_are_full(spark):
    """Rows are numbered without gaps over many tasks, so products do not grow with the tasks."""
    rows = spark.range(1000).select(F.array("id").alias("x")).repartition(37)
    numbers = sorted(r["row"] for r in whitening.numbered(rows).collect())
    assert numbers == list(range(1000))


def test_no_rows(spark):
    assert queries.whitened_columns(*whitening.whiten(table(spark, []))).count() == 0
    assert queries.whitened_columns(*whitening.whiten(table(spark, [(1, None), (2, [])]))).count() == 0


def test_without_spread(spark):
    """Equal vectors, and vectors on a line: components without spread are null."""
    same = queries.whitened_columns(*whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)}
    line = queries.whitened_columns(*whitening.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(9)]))).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and len(line) == 18


def test_large_entries(spark):
    """Deviations beyond a long are null, the rest stay exact; several lengths are refused."""
    rows = [(0, [0.0, 1.0]), (1, [1e8, 2.0]), (2, [3e8, 5.0]), (3, [1e30, 0.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table(spark, rows))[0].withColumnRenamed("id", "vec_id").collect()}
    assert got[3] is None
    rows = [(0, [0.0, 1.0]), (1, [1e6, 2.0]), (2, [2e6, 5.0])]
    fine = brute(rows, 1)
    assert {(r["vec_id"], r["deviation"]) for r in whitening.whiten(table(spark, rows))[0].withColumnRenamed("id", "vec_id").collect()} == {(i, fine[i, 1][0][1]) for i in range(3)}
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
