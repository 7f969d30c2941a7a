"""Known answers, golden summaries and properties of the operators."""

import bisect
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perigraph.columns import require_columns, resolve_column, resolve_roles, resolve_words
from perigraph.functions import geometric_grid, hash_normal, minimum_image, sinc, wrap
from perigraph.operators import bootstrap, brackets, compare, crossing, diffusion, fits, graph, heatkernel, length, merge, selection, spatial, spectrum, synthetic
from perigraph.queries import fixtures
from perigraph.session import nan_to_null


def rows(df):
    return [tuple(r) for r in df.collect()]


# Published summary of containment lengths by diffusion time, and their published fit.
CONTAINMENT = [(512, 146.62301266733354), (1024, 206.90389163494615), (2048, 300.8994828122955), (4096, 434.4005621521508), (8192, 600.7251045443246), (16384, 799.1886709733709)]
CONTAINMENT_FIT = (6.449187635001151, 0.0305671, 0.0524594)
# Published central curve: time, dimension, lower and upper band.
CENTRAL = [
    (512, None, None, None), (640, None, None, None), (768, None, None, None),
    (896, 3.0716831418595265, 3.0623843148413403, 3.0809052329388225), (1024, 3.0589434238745605, 3.0482232530709346, 3.069674538677625),
    (1280, 3.049877371100001, 3.0375614112859144, 3.061901409495188), (1536, 3.0407354897006815, 3.0264532516250795, 3.0548151193799806),
    (1792, 3.0322135311072786, 3.0157403002259584, 3.048549166684376), (2048, 3.023637576906534, 3.0042942481446278, 3.0428051541734673),
    (2560, 3.017569311149213, 2.995628020991954, 3.0392548660646654), (3072, 3.0121127410280986, 2.9870439915698492, 3.036791034907887),
    (3584, 3.0080675592922805, 2.97953546737772, 3.035724965173267), (4096, 3.005234846919629, 2.972497819895265, 3.036766429534862),
    (5120, 3.004827693811445, 2.9688657154310034, 3.03979169540383), (6144, 3.0069308818685165, 2.966710877051408, 3.0458681786362463),
    (7168, 3.010475237422878, 2.9655679017119927, 3.054477304481394), (8192, 3.0148020844143857, 2.963674504285542, 3.065435162571615),
    (10240, 3.018009058586064, 2.9602690765449378, 3.0753528769789735), (12288, None, None, None), (14336, None, None, None), (16384, None, None, None),
]


def test_containment_prefactor(spark):
    df = spark.createDataFrame(CONTAINMENT, "t int, ell double").withColumn("x", F.sqrt(F.col("t").cast("double")))
    got = length.prefactor_summary(df, "x", "ell").first()
    assert got["a"] == pytest.approx(CONTAINMENT_FIT[0], rel=1e-11)
    assert got["rms"] == pytest.approx(CONTAINMENT_FIT[1], abs=1e-7) and got["largest"] == pytest.approx(CONTAINMENT_FIT[2], abs=1e-7)


@pytest.fixture(scope="module")
def central(spark):
    return spark.createDataFrame(CENTRAL, "t int, ds double, lo double, hi double").withColumn("ok", F.expr("lo <= 3 and hi >= 3"))


def test_central_crossing_is_gated(central):
    assert crossing.interpolated_crossing(central, [], "t", crossing.spectral_margin("ds"), "ok").first()[0] == 2560.0


def test_trailing_flag(central):
    flagged = crossing.persistence_flags(central, [], "t", "abs(ds - 3) <= 0.03 and ok")
    assert flagged.filter("ends_run").agg(F.min("t")).first()[0] == 3584
    assert flagged.filter("starts_run").agg(F.min("t")).first()[0] == 2560


def test_plateau_golden(central):
    got = fits.plateau(central, [], "t", "ds", 3584).first()
    assert (got["n_late"], got["plateau_mean"], got["plateau_slope"]) == (7, pytest.approx(3.0097639089), pytest.approx(0.0110673239, rel=1e-6))


def test_null_control_has_dimension_three(spark):
    df = spark.createDataFrame([(p, t, (1 + 0.1 * p) * t**-0.7) for p in range(4) for t in (4, 8, 12, 16, 24, 32, 48)], "probe_index int, diffusion_time int, individual_trace_estimate double")
    control = merge.null_control(df, 8).groupBy(F.col("diffusion_time").alias("t")).agg(F.avg("individual_trace_estimate").alias("p"))
    found = fits.centred_dimension(control, [], "t", "p", 5).filter("ds is not null").collect()
    assert len(found) == 3 and all(r["ds"] == pytest.approx(3) and r["r2"] == pytest.approx(1) for r in found)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60), st.integers(1, 30))
def test_exact_top_is_a_sorted_prefix(spark, values, n):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int")
    got = sorted(r["id"] for r in selection.exact_top(df, "v", n, ["id"]).collect())
    assert got == sorted(i for i, _ in sorted(enumerate(values), key=lambda x: (-x[1], x[0]))[:n])


def test_order_statistic_large_and_tied(spark):
    df = spark.range(60_000).select((F.col("id") % 3).cast("double").alias("v"))
    assert selection.order_statistic(df, "v", 20_000) == 2.0 and selection.order_statistic(df, "v", 20_001) == 1.0
    df = spark.range(60_000).select(F.col("id").cast("double").alias("v"))
    assert selection.order_statistic(df, "v", 777) == 60_000 - 777 and selection.order_statistic(df, "v", 60_001) is None


def test_geometry(spark):
    got = spark.range(1).select(minimum_image(F.lit(9.0), 10), minimum_image(F.lit(-6.0), 10), wrap(F.lit(-0.25), 10), wrap(F.lit(10.0), 10), sinc(F.lit(0.0)), sinc(F.lit(0.5))).first()
    assert tuple(got) == (-1.0, 4.0, 9.75, 0.0, 1.0, pytest.approx(2 / math.pi))
    grid = geometric_grid(20, 600, 80)
    assert grid[0] == 20 and grid[-1] == 600 and len(grid) == 80 and grid == sorted(grid)


def random_points(spark, n, box=10.0, seed=3):
    xyz = np.random.default_rng(seed).random((n, 3)) * box
    return xyz, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")


def all_distances(xyz, box=10.0):
    gap = np.abs(xyz[:, None] - xyz[None])
    return np.sqrt((np.minimum(gap, box - gap) ** 2).sum(-1))


def test_neighbours_against_brute_force(spark):
    xyz, points = random_points(spark, 300)
    d = all_distances(xyz)
    np.fill_diagonal(d, np.inf)
    got = {(r["src"], r["rank"]): r["dst"] for r in spatial.nearest_neighbours(points, 4, 10.0).collect()}
    assert got == {(i, k + 1): j for i in range(300) for k, j in enumerate(np.argsort(d[i])[:4].tolist())}
    with pytest.raises(ValueError):
        spatial.nearest_neighbours(points, 40, 10.0, cells=8)


def test_neighbours_with_cells_meet_no_whole_cells(spark, monkeypatch):
    """Wide cells hold most of the points: the search goes by the tree, and the cells only decide what is refused."""
    monkeypatch.setattr(spatial, "close_pairs", lambda *a, **k: pytest.fail("pairs of whole cells"))
    xyz, points = random_points(spark, 300)
    d = all_distances(xyz)
    np.fill_diagonal(d, np.inf)
    got = {(r["src"], r["rank"]): r["dst"] for r in spatial.nearest_neighbours(points, 4, 10.0, cells=3).collect()}
    assert got == {(i, k + 1): j for i in range(300) for k, j in enumerate(np.argsort(d[i])[:4].tolist())}
    with pytest.raises(ValueError):
        spatial.nearest_neighbours(points, 4, 10.0, cells=12)


def test_places_of_large_keys(spark, tmp_path):
    """Products of these keys leave 64 bits; the places are those of whole numbers of any size."""
    keys, m = [1, 200_000, 600_000, 1_200_000, 7_200_000, 3_000_000_000], 1000003
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["id"]: (r["x"], r["y"], r["z"]) for r in fixtures.points(spark, str(tmp_path)).collect()}
    assert got == {p: tuple((p * p * a + p * b) % m / m * 100 for a, b in ((7919, 104729), (15485863, 32452843), (49979687, 67867967))) for p in keys}


@pytest.mark.parametrize("kind", ["long", "int"])
def test_places_of_keys_of_any_size(spark, tmp_path, kind):
    """Keys that were shifted far apart, to the largest of their type, and products that would leave it."""
    keys, m = [0, 19_999, 2_000_000_000, 2**31 - 1, *([10**12 + 5, 59 * 10**12, 2**63 - 1] if kind == "long" else [])], 1000003
    spark.createDataFrame([(k,) for k in keys], f"p_partkey {kind}").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["id"]: (r["x"], r["y"], r["z"]) for r in fixtures.points(spark, str(tmp_path)).collect()}
    assert got == {p: tuple((p * p * a + p * b) % m / m * 100 for a, b in ((7919, 104729), (15485863, 32452843), (49979687, 67867967))) for p in keys}


def test_radius_edges_meet_no_whole_cells(spark, monkeypatch):
    """Points in one cell of an even grid: edges go by the tree, whose leaves are bounded, not by copies of points in cells."""
    monkeypatch.setattr(spatial, "close_pairs", lambda *a, **k: pytest.fail("pairs of whole cells"))
    xyz, points = random_points(spark, 300)
    d = all_distances(xyz)
    got = {(r["src"], r["dst"]): r["dist"] for r in spatial.radius_edges(points, 1.5, 10.0).collect()}
    assert set(got) == {(i, j) for i in range(300) for j in range(300) if i != j and d[i, j] <= 1.5}
    assert all(got[i, j] == pytest.approx(d[i, j]) for i, j in got)
    with pytest.raises(ValueError, match="too large"):
        spatial.radius_edges(points, 3.4, 10.0)


def test_spheres_against_brute_force(spark):
    xyz, points = random_points(spark, 200)
    radii = [0.5, 1.0, 2.0, 3.5]
    got = {(r["center"], r["radius"]): r["count"] for r in spatial.counts_in_spheres(points.filter("id < 20"), points, radii, 10.0, 10).collect()}
    d = all_distances(xyz)
    assert got == {(i, r): int((d[i] <= r).sum()) - 1 for i in range(20) for r in radii}
    with pytest.raises(ValueError):
        spatial.counts_in_spheres(points, points, [6.0], 10.0, 20)


def test_graph_is_symmetric_and_complete(spark):
    _, points = random_points(spark, 150)
    edges = graph.neighbour_graph(spatial.nearest_neighbours(points, 3, 10.0))
    assert graph.asymmetric_edges(edges).isEmpty()
    report = graph.graph_report(edges, 150).first()
    assert report["n_diagonal"] == 0 and report["n_isolated"] == 0 and report["min_degree"] >= 3


def test_propagation_keeps_constants_and_matches_matrices(spark, tmp_path):
    _, points = random_points(spark, 60)
    edges = graph.neighbour_graph(spatial.nearest_neighbours(points, 3, 10.0)).persist()
    degree = graph.degrees(edges)
    walk = diffusion.transition(edges, degree)
    ones = diffusion.step(walk, points.select("id", F.lit(1.0).alias("y0")))
    assert ones.agg(F.max(F.abs(F.col("y0") - 1))).first()[0] < 1e-12
    a = np.zeros((60, 60))
    for r in edges.collect():
        a[r["src"], r["dst"]] = r["w"]
    p = a / a.sum(1, keepdims=True)
    probes = diffusion.gaussian_probes(points, 2, 5).persist()
    y = np.array([[r["y0"], r["y1"]] for r in probes.orderBy("id").collect()])
    want = {(t, i): 2 * float(y[:, i] @ np.linalg.matrix_power(p, t) @ y[:, i]) for t in (1, 3, 6) for i in (0, 1)}
    got = {(r["diffusion_time"], r["probe_index"]): r["individual_trace_estimate"] for r in diffusion.return_trace(edges, degree, probes, [1, 3, 6]).collect()}
    assert got == pytest.approx(want)
    folder = str(tmp_path / "states")
    diffusion.save_state(probes, folder, 0)
    first = diffusion.resume_trace(edges, degree, folder, [1, 3])
    assert first.count() == 4 and diffusion.saved_times(spark, folder) == [0, 1, 3]
    again = {(r["diffusion_time"], r["probe_index"]): r["individual_trace_estimate"] for r in diffusion.resume_trace(edges, degree, folder, [1, 3, 6], [1]).collect()}
    assert again == pytest.approx({k: v for k, v in want.items() if k[0] > 1})
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        diffusion.save_state(probes, folder, 3)


def test_probe_integrity(spark):
    full = [(p, t, 1.0) for p in range(4) for t in (1, 2)]
    make = lambda data: spark.createDataFrame(data, "probe_index int, diffusion_time int, individual_trace_estimate double")
    merge.require_complete(make(full), 4, [1, 2])
    for bad in (full[:-1], full + full[:1], [(p + 1, t, v) for p, t, v in full]):
        with pytest.raises(ValueError):
            merge.require_complete(make(bad), 4, [1, 2])


def test_transforms_agree_with_numpy_and_invert(spark):
    m = 4
    field = np.random.default_rng(1).random((m, m, m))
    df = spark.createDataFrame([(i, j, k, float(field[i, j, k])) for i in range(m) for j in range(m) for k in range(m)], "ix int, iy int, iz int, v double")
    want = np.fft.fftn(field)
    for f in (spectrum.transform, spectrum.transform_by_sums):
        got = np.zeros((m, m, m), complex)
        for r in f(df, m).collect():
            got[r["ix"], r["iy"], r["iz"]] = r["re"] + 1j * r["im"]
        assert np.allclose(got, want)
    back = spectrum.transform(spectrum.transform(df, m), m, inverse=True).join(df, ["ix", "iy", "iz"])
    assert back.agg(F.max(F.abs(F.col("re") - F.col("v")))).first()[0] < 1e-12


def test_shell_mode_counts(spark):
    found = {r["n2"]: r["n_modes"] for r in spectrum.shell_geometry(spark, 3).collect()}
    assert [found[i] for i in (1, 2, 3, 4)] == [6, 12, 8, 6]


def test_generated_field_recovers_its_spectrum(spark):
    table = spark.createDataFrame([(0.01, 50.0), (10.0, 50.0)], "k double, p double")
    modes = synthetic.coloured_modes(synthetic.white_noise(spark, 8, 2), synthetic.mode_powers(table, 8, 100.0), 8, 100.0)
    shells = spectrum.shell_spectrum(modes, 100.0, 8, 0, window=False)
    mean = shells.agg(F.sum(F.col("p_raw") * F.col("n_modes")) / F.sum("n_modes")).first()[0]
    assert mean == pytest.approx(50.0, rel=0.2)


def test_sampled_cells_follow_weights(spark):
    m = 2
    cells = spectrum.all_cells(spark, m).withColumn("v", (F.col("ix") * 2).cast("double"))
    got = {r["ix"]: r["count"] for r in synthetic.sampled_cells(synthetic.biased_weights(cells, 1.0), 4000, m, 9).groupBy("ix").count().collect()}
    assert sum(got.values()) == 4000 and got[1] / 4000 == pytest.approx(math.exp(2) / (1 + math.exp(2)), abs=0.03)


def test_survival(spark):
    df = spark.createDataFrame([(1, True), (2, True), (2, False), (3, False), (4, True)], "time int, event boolean")
    assert rows(compare.kaplan_meier(df).orderBy("time").select("time", "at_risk", F.round("survival", 9))) == [(1, 5, 0.8), (2, 4, 0.6), (4, 1, 0.0)]
    assert compare.survival_quantile(compare.kaplan_meier(df), 0.5).first()[0] == 4


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=25), st.lists(st.integers(0, 6), min_size=1, max_size=25))
def test_pair_counts(spark, a, b):
    first, second = (spark.createDataFrame([(float(v),) for v in x], "value double") for x in (a, b))
    got = compare.pair_order_counts(first, second).first()
    assert tuple(got) == (len(a) * len(b), sum(y < x for x in a for y in b), sum(y == x for x in a for y in b), sum(y > x for x in a for y in b))


def test_all_pairs_quantile(spark):
    a, b = [1.0, 2.0, 5.0], [2.0, 7.0]
    first, second = (spark.createDataFrame([(v,) for v in x], "value double") for x in (a, b))
    assert compare.all_pairs_quantile(first, second, 0.5) == pytest.approx(sorted(y - x for x in a for y in b)[2])
    assert compare.all_pairs_quantile(first.limit(0), second, 0.5) is None


def test_pair_quantiles_by_ranks(spark):
    """Tied, skewed and missing values: differences and ratios against all pairs."""
    rng = np.random.default_rng(6)
    a, b = np.round(rng.lognormal(0, 2, 60), 2) + 0.01, np.round(rng.lognormal(1, 2, 45), 1) + 0.1
    first, second = (spark.createDataFrame([(float(v),) for v in x] + [(None,)], "value double") for x in (a, b))
    pairs = np.sort((b[:, None] - a[None, :]).ravel())
    found = compare.pair_differences(compare.counted(first, "value"), compare.counted(second, "value"), [1, 700, 2700])
    assert [found[r] for r in (1, 700, 2700)] == pytest.approx([pairs[0], pairs[699], pairs[2699]])
    row = compare.all_pairs_ratio(first, second).first()
    assert tuple(row)[:5] == pytest.approx(np.quantile((a[:, None] / b[None, :]).ravel(), list(compare.QUANTILES.values()))) and row["n_pairs"] == 2700


def test_point_in_a_void(spark):
    """Only the points that lack neighbours look again; what they find is what all pairs give."""
    rng = np.random.default_rng(2)
    xyz = np.vstack([rng.random((300, 3)), [[7.0, 7.0, 7.0]], [[7.5, 2.0, 9.0]]])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    got = {}
    for r in spatial.nearest_neighbours(points, 4, 10.0).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    gap = np.abs(xyz[:, None] - xyz[None])
    d = (np.minimum(gap, 10 - gap) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 302 and all([got[i][k + 1] for k in range(4)] == np.argsort(d[i], kind="stable")[:4].tolist() for i in range(302))
    with pytest.raises(ValueError):
        spatial.nearest_neighbours(points, 4, 10.0, 9)


def test_quantiles_in_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(selection, "GATHERED", 8)
    values = [float(v) for v in np.random.default_rng(1).lognormal(0, 8, 500)] + [3.0] * 40 + [1e-300, 5e200]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    shares = [0.0, 0.02, 0.5, 0.77, 1.0]
    assert selection.quantiles(df, "v", shares) == pytest.approx(list(np.quantile(values, shares)))
    assert selection.quantiles(df.limit(0), "v", shares) == [None] * 5


def test_harmonics_in_batches_and_later_distances(spark, tmp_path):
    _, points = random_points(spark, 60)
    edges = graph.neighbour_graph(spatial.nearest_neighbours(points, 3, 10.0)).persist()
    degree, vectors = graph.degrees(edges), [(1, 0, 0), (0, 1, 0), (1, 1, 0)]
    whole, parts = (sorted(tuple(r) for r in diffusion.harmonic_correlations(edges, degree, points, vectors, [1, 2], 10.0, n).collect()) for n in (3, 2))
    assert len(whole) == 6 and [r[-1] for r in whole] == pytest.approx([r[-1] for r in parts])
    folder = str(tmp_path / "states")
    diffusion.save_state(diffusion.gaussian_probes(points, 2, 5), folder, 0)
    diffusion.resume_trace(edges, degree, folder, [2])
    pairs = spark.createDataFrame([(0, 1), (2, 50)], "id_i long, id_j long")
    assert diffusion.distances_at_checkpoints(pairs, folder, [0, 2]).count() == 4
    with pytest.raises(ValueError, match="checkpoint"):
        diffusion.distances_at_checkpoints(pairs, folder, [1])


def test_crossing_variants(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 3.5), (4, 2.9), (8, 3.0), (16, 3.0)], "t int, y double")
    margin = "(0.2D - abs(y - 3))"
    log = crossing.interpolated_crossing(df, [], "t", margin).first()[0]
    linear = crossing.interpolated_crossing(df, [], "t", margin, scale="linear").first()[0]
    w = 0.3 / 0.4
    assert log == pytest.approx(math.exp(math.log(2) + w * math.log(2))) and linear == pytest.approx(2 + 2 * w)
    assert crossing.downward_crossing(df, [], "t", "y", 3.2).first()[0] == pytest.approx(2 + 2 * 0.5)
    assert crossing.first_persistent(df, [], "t", "abs(y - 3) <= 0.2", 4).first()[0] is None
    assert crossing.sign_change(df.withColumn("d", F.col("y") - 3.25), [], "t", "d").first()[0] == pytest.approx(2 + 2 * 0.25 / 0.6)


def test_missing_values_never_pass(spark):
    df = nan_to_null(spark.createDataFrame([(1, float("nan")), (2, float("nan")), (3, 1.0)], "t int, m double"))
    assert crossing.first_persistent(df, [], "t", "m >= 0", 2).first()[0] is None
    empty = spark.createDataFrame([], "b int, t int, m double")
    assert crossing.interpolated_crossing(empty, ["b"], "t", "m").count() == 0
    assert fits.centred_dimension(empty, ["b"], "t", "m").count() == 0


def test_gradient_is_exact_for_parabolas(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x * x - x) for x in (1, 2, 4, 5, 9)], "x double, y double")
    from perigraph.functions import three_point_gradient

    got = df.withColumn("g", three_point_gradient("y", "x", [])).collect()
    assert all(r["g"] == pytest.approx(4 * r["x"] - 1) for r in got)


def test_interpolation_hits_nodes_and_clamps(spark):
    table = spark.createDataFrame([(1.0, 10.0), (2.0, 30.0), (4.0, 20.0)], "k double, p double")
    at = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (4.0,), (9.0,)], "at double")
    got = [r["value"] for r in heatkernel.interpolate_at(at, table, "k", "p").orderBy("at").collect()]
    assert got == [10.0, 10.0, 20.0, 20.0, 20.0]
    assert heatkernel.interpolate_at(at, table, "k", "p", clamp=False).filter("value is null").count() == 2


@pytest.mark.parametrize("short", [1024, 0])
def test_brackets(spark, monkeypatch, short):
    """Broadcast or by ranges: rows around each place, against a search in the sorted curve; ties, hot places, nulls, empty tables."""
    monkeypatch.setattr(brackets, "SHORT_CURVE", short)
    rng = random.Random(4)
    curve = [(rng.randint(0, 60) / 2, rng.randint(0, 9)) for _ in range(45)] + [(None, 1)]
    places = [rng.choice([7.25, rng.uniform(-5, 40), rng.randint(0, 60) / 2]) for _ in range(300)] + [None, -9.0, 99.0]
    best = {}
    for x, y in curve[:-1]:
        best[x] = max(y, best.get(x, y))
    xs = sorted(best)
    want = []
    for i, p in enumerate(places):
        k = bisect.bisect_right(xs, p) if p is not None else None
        low, high = (None, None) if k is None else (xs[k - 1] if k else None, xs[k] if k < len(xs) else None)
        want.append((i, low, best.get(low), high, best.get(high)))
    p, c = spark.createDataFrame(list(enumerate(places)), "i int, at double"), spark.createDataFrame(curve, "t double, y int")
    got = brackets.bracketed(p, "at", c, "t", "y")
    assert sorted(tuple(r) for r in got.select("i", "x0", "y0", "x1", "y1").collect()) == want
    none = brackets.bracketed(p, "at", c.limit(0), "t", "y").filter("x0 is null and y0 is null and x1 is null and y1 is null")
    assert none.count() == len(places) and brackets.bracketed(p.limit(0), "at", c, "t", "y").count() == 0


def test_draws_are_uniform_and_normal(spark):
    got = spark.range(20_000).select(hash_normal(F.lit(1), F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert got[0] == pytest.approx(0, abs=0.03) and got[1] == pytest.approx(1, abs=0.03)
    counts = [r["count"] for r in bootstrap.draws(spark, 300, 10, 1).groupBy("unit").count().collect()]
    assert len(counts) == 10 and min(counts) > 230 and max(counts) < 370


def test_tiles_and_simplices(spark):
    points = spark.createDataFrame([(1, 0.5, 5.0, 9.8)], "id int, x double, y double, z double")
    assert graph.tile_periodic(points, 10.0, 1.0).count() == 4
    tetra = spark.createDataFrame([(1, 2, 3, 4), (2, 1, 3, 5)], "a int, b int, c int, d int")
    assert graph.simplices_to_edges(tetra).count() == 9
    assert graph.reconcile({"a": 1, "b": 2.0, "c": "x"}, {"a": 1, "b": 2.5, "c": "x"}, 0.1) == ["b"]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "Diffusion_Time int, `P return` double")
    assert resolve_column(df.columns, ["time", "diffusion_time"]) == "Diffusion_Time"
    assert resolve_words(df.columns, ["p", "return"]) == "P return"
    assert resolve_roles(df, {"t": ["diffusion_time"], "p": ["P return"]}).columns == ["t", "p"]
    with pytest.raises(ValueError):
        resolve_roles(df, {"q": ["none"]})
    with pytest.raises(ValueError):
        require_columns(df, ["x"])


def test_merges(spark):
    kind = "diffusion_time int, length double"
    merged = length.merge_lengths(spark.createDataFrame([(1, 1.0), (2, 2.0)], kind), spark.createDataFrame([(2, 9.0), (3, 3.0)], kind))
    assert sorted(rows(merged)) == [(1, 1.0), (2, 9.0), (3, 3.0)]
    parts = [spark.createDataFrame([(t, h) for t in (1, 2)], "diffusion_time int, harmonic int") for h in (1, 2)]
    assert length.merged_harmonics(parts, [1, 2]).count() == 4
    with pytest.raises(ValueError):
        length.merged_harmonics(parts, [1, 2, 3])
