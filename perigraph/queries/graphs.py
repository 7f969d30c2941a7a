"""Spatial, graph and diffusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometric_grid, linear_grid
from ..operators import blocks, checkpoints, delaunay
from ..operators import diffusion as walk
from ..operators import graph as op
from ..operators import spatial
from ..operators.selection import target_count
from ..session import fresh_path
from .fixtures import BOX, GRAPH, K, KNN, POINTS, TRACE, d2, knn_graph, neighbours, points, rounded, trace
from .selection import pair_list

VECTORS = [(1, 0, 0), (0, 1, 0), (1, 1, 0), (1, 1, 1)]
STEPS = 3


def c3_neighbours(spark, sf):
    return rounded(neighbours(spark, sf))


def c5_radius_graph(spark, sf):
    p = points(spark, sf)
    return rounded(spatial.radius_edges(p, spatial.target_radius(p.count(), 10, BOX), BOX))


def c6_symmetric_graph(spark, sf):
    return knn_graph(spark, sf)


def c7_gaussian_graph(spark, sf):
    return rounded(op.gaussian_graph(neighbours(spark, sf), K))


def c8_tiles(spark, sf):
    return rounded(op.tile_periodic(points(spark, sf), BOX, 10.0))


def c8_delaunay(spark, sf):
    return delaunay.periodic_delaunay(points(spark, sf), BOX)


def c9_truncated_graph(spark, sf):
    return op.neighbour_graph(neighbours(spark, sf), 3)


def c11_degrees(spark, sf):
    return op.degrees(knn_graph(spark, sf))


def c14_coordinate_report(spark, sf):
    return rounded(op.coordinate_report(points(spark, sf), BOX))


def c15_graph_report(spark, sf):
    return rounded(op.graph_report(knn_graph(spark, sf), points(spark, sf).count()))


def c16_reverse_check(spark, sf):
    return op.sampled_reverse_check(knn_graph(spark, sf), 500, 12345)


def c17_degree_statistics(spark, sf):
    return rounded(op.degree_statistics(op.degrees(knn_graph(spark, sf))))


def c18_asymmetric(spark, sf):
    directed = neighbours(spark, sf).select("src", "dst", F.lit(1.0).alias("w"))
    return op.asymmetric_edges(directed).select("src", "dst")


def c19_edge_lengths(spark, sf):
    lengths = op.edge_lengths(knn_graph(spark, sf), points(spark, sf), BOX)
    return rounded(op.degree_statistics(lengths, "length"))


def c21_induced_edges(spark, sf):
    return op.induced_edges(knn_graph(spark, sf), points(spark, sf).filter("x < 40 and y < 40")).select("src", "dst")


def k2_counts_in_spheres(spark, sf):
    p = points(spark, sf)
    return spatial.counts_in_spheres(p, p, [5.0, 10.0, 15.0, 20.0], BOX, 10).select("center", "radius", "count")


def curve_blocks(spark, sf):
    """Blocks of about 512 points along the space-filling curve."""
    return blocks.cut_by(points(spark, sf), blocks.morton_code(BOX), 512)


def d10_single_source(spark, sf):
    """Three steps in one round: halos of three layers, one exchange."""
    edges = knn_graph(spark, sf)
    state = blocks.state_after(walk.transition(edges, op.degrees(edges)), curve_blocks(spark, sf), walk.one_hot(points(spark, sf), 7), STEPS, 3)
    return rounded(state.filter("y0 > 0").withColumn("y0", F.col("y0") * 1000))


def probes(spark, sf):
    return points(spark, sf).select("id", *[(((F.col("id") * 37 + 11 * (i + 1)) % 101 - 50) / 50.0).alias(f"y{i}") for i in range(3)])


def d4_trace(spark, sf):
    edges = knn_graph(spark, sf)
    return rounded(walk.return_trace(edges, op.degrees(edges), probes(spark, sf), [0, 1, 2], curve_blocks(spark, sf), 2))


def d5_trace_summary(spark, sf):
    edges = knn_graph(spark, sf)
    trace = walk.return_trace(edges, op.degrees(edges), probes(spark, sf), [0, 2])
    return rounded(walk.trace_summary(trace, points(spark, sf).count()))


def d1_gaussian_probes(spark, sf):
    """Mean and square of the entries: 0 and 1 for a sum over probes, within sampling error."""
    y = walk.gaussian_probes(points(spark, sf), 4, 12345)
    return y.agg(F.avg("y0").alias("mean"), F.avg(F.expr("y0*y0 + y1*y1 + y2*y2 + y3*y3")).alias("square"))


def d7_resume_point(spark, sf):
    """Days of the events: every eighth has a checkpoint, every third is asked for, those before the 20th are done."""
    days = trace(spark, sf).select(F.col("diffusion_time").alias("time")).distinct()
    return walk.resume_point(days.filter("time % 8 = 0"), days.filter("time % 3 = 0"), days.filter("time % 3 = 0 and time < 20"))


def d8_missing_times(spark, sf):
    times = trace(spark, sf).select("diffusion_time").distinct()
    return spark.range(1, 40).select(F.col("id").cast("int").alias("diffusion_time")).join(times, "diffusion_time", "left_anti")


def i2_mode_correlations(spark, sf):
    edges = knn_graph(spark, sf)
    first = walk.fourier_modes(points(spark, sf), VECTORS, BOX)
    steps = walk.transition(edges, op.degrees(edges))
    return rounded(walk.mode_correlations(first, walk.step(steps, walk.step(steps, first)), VECTORS, 2, BOX))


def j1_diffusion_distances(spark, sf):
    edges = knn_graph(spark, sf)
    steps = walk.transition(edges, op.degrees(edges))
    return rounded(walk.diffusion_distances(pair_list(spark, sf), walk.step(steps, probes(spark, sf))))


def c4_guard(spark, sf):
    """Fixed cells are refused where they could miss a neighbour."""
    table, out = neighbours(spark, sf), []
    for cells in (3, 40):
        try:
            spatial.require_cells(table, points(spark, sf), K, BOX, cells)
            out.append((cells, False))
        except ValueError:
            out.append((cells, True))
    return spark.createDataFrame(out, "cells int, refused boolean")


def c12_zero_degree(spark, sf):
    """A node of zero degree is clamped, or refused."""
    edges = knn_graph(spark, sf).withColumn("w", F.when(F.col("src") == 7, 0.0).otherwise(F.col("w")))
    try:
        op.degrees(edges, "raise")
        refused = False
    except ValueError:
        refused = True
    return op.degrees(edges).filter("id = 7").select("id", "degree").withColumn("refused", F.lit(refused))


def c20_reconciled(spark, sf):
    """Names whose recorded value is missing or another."""
    report = op.graph_report(knn_graph(spark, sf), points(spark, sf).count()).first().asDict()
    recorded = {k: v + (k == "n_isolated") for k, v in report.items() if k != "max_degree"}
    return spark.createDataFrame([(n,) for n in op.reconcile(report, recorded)], "name string")


def k3_guard(spark, sf):
    """Radii over half the box, or that span the whole grid, are refused (no pairs); of the others, all pairs within them."""
    p, out = points(spark, sf), []
    for radius, cells in ((20.0, 10), (45.0, 10), (51.0, 200)):
        try:
            counts = spatial.counts_in_spheres(p, p, [radius], BOX, cells)
            out.append(counts.agg(F.lit(radius).alias("radius"), F.sum("count").alias("pairs"), F.lit(False).alias("refused")))
        except ValueError:
            out.append(spark.range(1).select(F.lit(radius).alias("radius"), F.lit(0).cast("long").alias("pairs"), F.lit(True).alias("refused")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def k4_radii(spark, sf):
    """Grids between the least and the largest distance of neighbours, and how many lie within each inner radius.

    As in SQL, no radius of the logarithmic grid is a number where points coincide, and all distances lie below it."""
    found = neighbours(spark, sf)
    lo, hi = found.agg(F.min("dist"), F.max("dist")).first()
    log, linear = (geometric_grid(lo, hi, 9), linear_grid(lo, hi, 6)) if lo is not None else ([None] * 9, [None] * 6)
    grid = [(name, i, values[i]) for name, values in (("log", log), ("linear", linear)) for i in range(1, len(values) - 1)]
    radius = lambda r: F.lit(r).cast("double")
    counted = found.agg(F.array(*[F.struct(F.lit(n).alias("grid"), F.lit(i).alias("i"), radius(r).alias("radius"), F.count_if(F.col("dist") <= radius(r)).alias("n")) for n, i, r in grid]).alias("g"))
    return rounded(counted.select(F.explode("g").alias("e")).select("e.*"))


def b1_target_count(spark, sf):
    """Points that cubes of some sides should hold at the box's density, and how many they do."""
    p = points(spark, sf)
    density, sides = p.count() / BOX**3, (20, 30, 40, 60, 90)
    rows = [F.struct(F.lit(s).alias("side"), F.lit(target_count(density, float(s))).cast("long").alias("target"), F.count_if((F.col("x") < s) & (F.col("y") < s) & (F.col("z") < s)).alias("found")) for s in sides]
    return p.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("e")).select("e.*")


def d6_kept_states(spark, sf):
    """A trace whose states are committed and removed as it runs; the states that are left."""
    edges, folder = knn_graph(spark, sf), fresh_path(spark, "d6")
    out = checkpoints.resumable_trace(edges, op.degrees(edges), probes(spark, sf), folder, [1, 2], 1, 1, curve_blocks(spark, sf), 2)
    return rounded(out).withColumn("n_states", F.lit(len(checkpoints.StateLog(spark, folder).names("states"))).cast("long"))


def d9_resumed(spark, sf):
    """Checkpoints at 0 and 1: time 1 is taken from its own, time 2 goes on from it, time 0 is completed already."""
    edges, folder = knn_graph(spark, sf), fresh_path(spark, "d9")
    degree = op.degrees(edges)
    walk.save_state(probes(spark, sf), folder, 0)
    walk.resume_trace(edges, degree, folder, [1])
    return rounded(walk.resume_trace(edges, degree, folder, [0, 1, 2], [0]))


def i15_harmonics(spark, sf):
    """The correlations of i2, two wave vectors at a time."""
    edges = knn_graph(spark, sf)
    return rounded(walk.harmonic_correlations(edges, op.degrees(edges), points(spark, sf), VECTORS, [2], BOX, 2))


def j6_later_distances(spark, sf):
    """Distances of pairs at a saved state."""
    edges, folder = knn_graph(spark, sf), fresh_path(spark, "j6")
    walk.save_state(probes(spark, sf), folder, 0)
    walk.resume_trace(edges, op.degrees(edges), folder, [1])
    return rounded(walk.distances_at_checkpoints(pair_list(spark, sf), folder, [1]).drop("diffusion_time"))


QUERIES = {f.__name__: f for f in (b1_target_count, d6_kept_states, c4_guard, c12_zero_degree, c20_reconciled, k3_guard, k4_radii, d9_resumed, i15_harmonics, j6_later_distances, c3_neighbours, c5_radius_graph, c6_symmetric_graph, c7_gaussian_graph, c8_tiles, c8_delaunay, c9_truncated_graph, c11_degrees, c14_coordinate_report, c15_graph_report, c16_reverse_check, c17_degree_statistics, c18_asymmetric, c19_edge_lengths, c21_induced_edges, k2_counts_in_spheres, d1_gaussian_probes, d4_trace, d5_trace_summary, d7_resume_point, d8_missing_times, d10_single_source, i2_mode_correlations, j1_diffusion_distances)}


def statistics(value: str) -> str:
    shares = ", ".join(f"round(quantile_cont({value}, {s}), 6) AS q{round(100 * s):03d}" for s in op.DEGREE_SHARES)
    return f"round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS std, {shares}"


def stepped(source: str, columns: list[str], name: str) -> str:
    sums = ", ".join(f"sum(w * {c}) / any_value(degree) AS {c}" for c in columns)
    return f"{name} AS (SELECT src AS id, {sums} FROM graph JOIN {source} s ON s.id = dst JOIN deg ON deg.id = src GROUP BY src)"


Y = ["y0", "y1", "y2"]
PROBE_SQL = "probe AS (SELECT id, " + ", ".join(f"((id * 37 + {11 * (i + 1)}) % 101 - 50) / 50.0::DOUBLE AS y{i}" for i in range(3)) + " FROM points)"
WALKED = f"{GRAPH}, {PROBE_SQL}, {stepped('probe', Y, 's1')}, {stepped('s1', Y, 's2')}"
ESTIMATES = " UNION ALL ".join(f"SELECT {t} AS diffusion_time, {i} AS probe_index, 3 * sum(a.y{i} * b.y{i}) AS individual_trace_estimate FROM probe a JOIN {s} b USING (id)" for t, s in ((0, "probe"), (1, "s1"), (2, "s2")) for i in range(3))


def phase(v: tuple[int, int, int]) -> str:
    return " + ".join(f"{2 * 3.141592653589793 * n / BOX!r}::DOUBLE * {c}" for n, c in zip(v, "xyz", strict=True))


MODES = "mode AS (SELECT id, " + ", ".join(f"cos({phase(v)}) AS c{i}, sin({phase(v)}) AS s{i}" for i, v in enumerate(VECTORS)) + " FROM points)"
NAMES = [f"{n}{i}" for i in range(len(VECTORS)) for n in "cs"]
CORRELATIONS = " UNION ALL ".join(
    f"SELECT 2 AS diffusion_time, {v[0]} AS nx, {v[1]} AS ny, {v[2]} AS nz, {sum(n * n for n in v)} AS n2, round({(2 * 3.141592653589793 / BOX) ** 2 * sum(n * n for n in v)!r}::DOUBLE, 6) AS k2, round(sum(a.c{i} * b.c{i} + a.s{i} * b.s{i}) / sum(a.c{i} * a.c{i} + a.s{i} * a.s{i}), 6) AS correlation FROM mode a JOIN m2 b USING (id)"
    for i, v in enumerate(VECTORS)
)
REPORT = ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in "xyz" for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop")))
ORACLE_SQL = {
    "c3_neighbours": f"WITH {KNN} SELECT src, rank, dst, round(dist, 6) AS dist FROM knn",
    "c5_radius_graph": f"WITH {POINTS} SELECT a.id AS src, b.id AS dst, round(sqrt({d2('a', 'b')}), 6) AS dist FROM points a JOIN points b ON a.id <> b.id WHERE sqrt({d2('a', 'b')}) <= pow(3 * 10 / (4 * pi() * (SELECT count(*) FROM points) / 1e6), 1.0 / 3)",
    "c6_symmetric_graph": f"WITH {GRAPH} SELECT src, dst, w FROM graph",
    "c7_gaussian_graph": f"WITH {KNN}, eps AS (SELECT quantile_cont(dist, 0.5) AS e FROM knn WHERE rank = {K}), g AS (SELECT src, dst, exp(-dist * dist / (e * e)) AS w FROM knn, eps) SELECT src, dst, round(max(w), 6) AS w FROM (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g) GROUP BY src, dst",
    "c8_tiles": f"WITH {POINTS}, s AS (SELECT unnest([-100.0, 0.0, 100.0])::DOUBLE AS s) SELECT id AS owner, round(x + a.s, 6) AS x, round(y + b.s, 6) AS y, round(z + c.s, 6) AS z FROM points, s a, s b, s c WHERE x + a.s >= -10 AND x + a.s < 110 AND y + b.s >= -10 AND y + b.s < 110 AND z + c.s >= -10 AND z + c.s < 110",
    "c9_truncated_graph": f"WITH {KNN} SELECT src, dst, 1.0::DOUBLE AS w FROM knn WHERE rank <= 3 UNION SELECT dst, src, 1.0::DOUBLE FROM knn WHERE rank <= 3",
    "c11_degrees": f"WITH {GRAPH} SELECT id, degree FROM deg",
    "c14_coordinate_report": f"WITH {POINTS} SELECT count(*) AS n, 0::BIGINT AS n_not_finite, count(*) FILTER (NOT (x >= 0 AND x < 100 AND y >= 0 AND y < 100 AND z >= 0 AND z < 100)) AS n_outside, {REPORT} FROM points",
    "c15_graph_report": f"WITH {GRAPH} SELECT sum(degree)::BIGINT AS nnz, 0::BIGINT AS n_diagonal, 0::BIGINT AS n_not_finite, (SELECT count(*) FROM points) - count(*) AS n_isolated, min(degree)::BIGINT AS min_degree, max(degree)::BIGINT AS max_degree, round(sum(degree) / (SELECT count(*) FROM points), 6) AS mean_degree FROM deg",
    "c16_reverse_check": f"WITH {GRAPH} SELECT least(500, count(*)) AS n_sampled, 0::BIGINT AS n_without_reverse FROM graph",
    "c17_degree_statistics": f"WITH {GRAPH} SELECT {statistics('degree')} FROM deg",
    "c18_asymmetric": f"WITH {KNN} SELECT src, dst FROM knn EXCEPT SELECT dst, src FROM knn",
    "c19_edge_lengths": f"WITH {GRAPH}, l AS (SELECT sqrt({d2('a', 'b')}) AS length FROM graph JOIN points a ON a.id = src JOIN points b ON b.id = dst) SELECT {statistics('length')} FROM l",
    "c21_induced_edges": f"WITH {GRAPH}, own AS (SELECT id FROM points WHERE x < 40 AND y < 40) SELECT src, dst FROM graph WHERE src < dst AND src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own)",
    "k2_counts_in_spheres": f"WITH {POINTS}, r AS (SELECT unnest([5.0, 10.0, 15.0, 20.0])::DOUBLE AS radius), pairs AS (SELECT a.id, {d2('a', 'b')} AS d2 FROM points a JOIN points b ON a.id <> b.id), near AS (SELECT id, radius, count(*) AS n FROM pairs JOIN r ON d2 <= radius * radius GROUP BY 1, 2) SELECT c.id AS center, r.radius, coalesce(n, 0) AS count FROM points c CROSS JOIN r LEFT JOIN near ON near.id = c.id AND near.radius = r.radius",
    "d4_trace": f"WITH {WALKED}, e AS ({ESTIMATES}) SELECT diffusion_time, probe_index, round(individual_trace_estimate, 6) AS individual_trace_estimate FROM e",
    "d5_trace_summary": f"""WITH {WALKED}, e AS ({ESTIMATES}), n AS (SELECT count(*) AS n FROM points), s AS (SELECT diffusion_time, count(*) AS n_probes, avg(individual_trace_estimate) AS trace, stddev_samp(individual_trace_estimate) / sqrt(3) AS se FROM e WHERE diffusion_time <> 1 GROUP BY 1)
      SELECT diffusion_time, n_probes, round(trace, 6) AS trace, round(se, 6) AS trace_se, round(trace / n, 6) AS p_return, round(se / n, 6) AS p_return_se, round(se / trace, 6) AS relative_se FROM s, n""",
    "d7_resume_point": f"WITH {TRACE}, days AS (SELECT DISTINCT diffusion_time AS t FROM trace), missing AS (SELECT min(t) AS m FROM days WHERE t % 3 = 0 AND t >= 20) SELECT max(t) AS resume, max(m) AS first_missing FROM days, missing WHERE t % 8 = 0 AND t <= m",
    "b1_target_count": f"WITH {POINTS}, s AS (SELECT unnest([20, 30, 40, 60, 90])::INT AS side) SELECT side, round((SELECT count(*) FROM points) * side * side * side / 1e6)::BIGINT AS target, (SELECT count(*) FROM points WHERE x < side AND y < side AND z < side) AS found FROM s",
    "d6_kept_states": f"WITH {WALKED}, e AS ({ESTIMATES}) SELECT diffusion_time, probe_index, round(individual_trace_estimate, 6) AS individual_trace_estimate, 2::BIGINT AS n_states FROM e WHERE diffusion_time > 0",
    "d8_missing_times": "SELECT i::INT AS diffusion_time FROM range(1, 40) r(i) WHERE i NOT IN (SELECT day(ts) FROM events WHERE value > 0)",
    "d10_single_source": f"WITH {GRAPH}, s0 AS (SELECT id, (id = 7)::INT::DOUBLE AS y0 FROM points), {stepped('s0', ['y0'], 's1')}, {stepped('s1', ['y0'], 's2')}, {stepped('s2', ['y0'], 's3')} SELECT id, round(1000 * y0, 6) AS y0 FROM s3 WHERE y0 > 0",
    "i2_mode_correlations": f"WITH {GRAPH}, {MODES}, {stepped('mode', NAMES, 'm1')}, {stepped('m1', NAMES, 'm2')} {CORRELATIONS}",
    "j1_diffusion_distances": f"""WITH {WALKED}, pairs AS (
        SELECT a.id AS id_i, b.id AS id_j, sqrt({d2("a", "b")}) AS distance, sqrt({" + ".join(f"pow(p.{c} - q.{c}, 2)" for c in Y)}) AS dd
        FROM points a JOIN points b ON b.id = (a.id * 37) % (SELECT count(*) FROM points) + 1 AND a.id <> b.id JOIN s1 p ON p.id = a.id JOIN s1 q ON q.id = b.id)
      SELECT id_i, id_j, round(distance, 6) AS distance, round(dd, 6) AS diffusion_distance, round(dd / (SELECT sqrt(avg(dd * dd)) FROM pairs), 6) AS normalised FROM pairs""",
    "c4_guard": f"WITH {KNN}, kth AS (SELECT max(dist) AS most FROM knn WHERE rank = {K}) SELECT cells::INT AS cells, most >= {BOX} / cells AS refused FROM kth, (SELECT unnest([3, 40]) AS cells)",
    "c12_zero_degree": "SELECT 7::BIGINT AS id, 1e-20::DOUBLE AS degree, true AS refused",
    "c20_reconciled": "SELECT unnest(['n_isolated', 'max_degree']) AS name",
    "k3_guard": f"WITH {POINTS}, near AS (SELECT count(*) AS n FROM points a JOIN points b ON a.id <> b.id WHERE {d2('a', 'b')} <= 400) SELECT r::DOUBLE AS radius, CASE WHEN r = 20 THEN (SELECT n FROM near) ELSE 0 END AS pairs, r >= 50 OR 2 * ceil(r / (100.0 / c)) + 1 > c AS refused FROM (VALUES (20.0, 10), (45.0, 10), (51.0, 200)) t(r, c)",
    "k4_radii": f"WITH {KNN}, ends AS (SELECT min(dist) AS lo, max(dist) AS hi FROM knn), g AS (SELECT 'log' AS grid, i::INT AS i, lo * pow(hi / lo, i / 8.0::DOUBLE) AS radius FROM ends, range(1, 8) r(i) UNION ALL SELECT 'linear', i::INT, lo + (hi - lo) * i / 5.0::DOUBLE FROM ends, range(1, 5) r(i)) SELECT grid, i, round(radius, 6) AS radius, (SELECT count(*) FROM knn WHERE dist <= g.radius) AS n FROM g",
    "d9_resumed": f"WITH {WALKED}, e AS ({ESTIMATES}) SELECT diffusion_time, probe_index, round(individual_trace_estimate, 6) AS individual_trace_estimate FROM e WHERE diffusion_time > 0",
    "i15_harmonics": f"WITH {GRAPH}, {MODES}, {stepped('mode', NAMES, 'm1')}, {stepped('m1', NAMES, 'm2')} {CORRELATIONS}",
}
ORACLE_SQL["j6_later_distances"] = ORACLE_SQL["j1_diffusion_distances"]
