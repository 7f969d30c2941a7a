"""The half transform of a real field against numpy."""

import numpy as np
import pytest

from perigraph.operators import spectrum


@pytest.mark.parametrize(("m", "pencil"), [(8, 16), (7, 1), (6, 1 << 16)])
def test_half_spectrum(spark, m, pencil):
    """Bundles of one line, of two and of all; even and odd sides."""
    v = np.random.default_rng(m).normal(size=(m, m, m))
    field = spark.createDataFrame([(int(i), int(j), int(k), float(v[i, j, k])) for i, j, k in np.ndindex(m, m, m)], "ix int, iy int, iz int, v double")
    half = spectrum.real_transform(field, m, pencil)
    want = np.fft.fftn(v)
    got = {(r["ix"], r["iy"], r["iz"]): complex(r["re"], r["im"]) for r in half.collect()}
    assert len(got) == m * m * (m // 2 + 1) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    whole = {(r["ix"], r["iy"], r["iz"]): complex(r["re"], r["im"]) for r in spectrum.completed(half, m).collect()}
    assert len(whole) == m**3 and all(abs(whole[k] - want[k]) < 1e-9 for k in whole)
    full = {r["n2"]: (r["p_raw"], r["n_modes"]) for r in spectrum.shell_spectrum(spectrum.transform(field, m), 10.0, m, 100).collect()}
    by_half = {r["n2"]: (r["p_raw"], r["n_modes"]) for r in spectrum.shell_spectrum(half, 10.0, m, 100, half=True).collect()}
    assert full.keys() == by_half.keys() and all(full[n][1] == by_half[n][1] and full[n][0] == pytest.approx(by_half[n][0]) for n in full)


def test_no_task_holds_a_plane(spark):
    """A plane of 64 by 64 values is dealt to bundles of 8 lines."""
    m = 64
    field = spectrum.all_cells(spark, m).selectExpr("ix", "iy", "iz", "cos(2 * pi() * (3 * ix + 5 * iz) / 64) as v")
    half = spectrum.real_transform(field, m, 8 * m)
    large = half.filter("abs(re) + abs(im) > 1").collect()
    assert {(r["ix"], r["iy"], r["iz"]) for r in large} == {(3, 0, 5)} and large[0]["re"] == pytest.approx(m**3 / 2)
    plan = half._jdf.queryExecution().optimizedPlan().toString()
    assert "div 8" in plan
