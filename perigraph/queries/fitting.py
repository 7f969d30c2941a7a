"""Merging, regression, bootstrap and crossing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as boots
from ..operators import crossing as op
from ..operators import fits, merge
from .fixtures import BOOT, BOOT_SPECTRAL, CURVE, PROBES, REPLICATES, SPECTRAL, TRACE, boot_means, crossing, curve, persistent, quantiles, rounded, trace, windowed

V = "individual_trace_estimate"
MARGIN = "(0.1D - abs(ds - 3D))"
DUCK_MARGIN = "(0.1 - abs(ds - 3))"


def spectral(spark, sf):
    return fits.centred_dimension(curve(spark, sf), [], "t", "p", 7)


def boot_spectral(spark, sf):
    return fits.centred_dimension(boot_means(spark, sf), ["b"], "t", "p", 7)


def halves(spark, sf):
    t = trace(spark, sf)
    local = F.col("probe_index") % 8
    return [t.filter(F.col("probe_index").between(8 * i, 8 * i + 7)).withColumn("probe_index", local) for i in (0, 1)]


def e2_merge_batches(spark, sf):
    return rounded(merge.merge_batches(halves(spark, sf), 8))


def e3_merge_by_time(spark, sf):
    early, late = halves(spark, sf)
    return rounded(merge.merge_by_time(early, late, 15).groupBy("diffusion_time").agg(F.count(F.lit(1)).alias("n"), F.avg(V).alias("mean")))


def e4_time_summary(spark, sf):
    return rounded(merge.time_summary(trace(spark, sf), V, 100.0))


def e5_integrity(spark, sf):
    return merge.integrity(trace(spark, sf))


def e7_orders(spark, sf):
    """Places of a trace's rows by probe and by time."""
    return rounded(merge.with_orders(trace(spark, sf).select("probe_index", "diffusion_time", "individual_trace_estimate")))


def e9_probe_matrix(spark, sf):
    """Two traces of the same probes and times, held to be complete; one that lacks a row is refused."""
    t, days = trace(spark, sf), list(range(1, 31))
    whole = merge.require_complete(t, PROBES, days)
    try:
        merge.require_complete(t.filter("probe_index <> 3 or diffusion_time <> 7"), PROBES, days)
        refused = False
    except ValueError:
        refused = True
    return rounded(whole.groupBy("probe_index").agg(F.count(F.lit(1)).alias("n"), F.sum("individual_trace_estimate").alias("total")).withColumn("refused", F.lit(refused)))


def g1_drawn_units(spark, sf):
    """How often each probe of the trace is drawn over all replicates, with replacement, as many times as there are probes."""
    probes = trace(spark, sf).select(F.col("probe_index").alias("unit")).distinct()
    counts = boots.multiplicities(boots.lattice_draws(spark, REPLICATES, probes.count()))
    return probes.join(counts, "unit").groupBy("unit").agg(F.sum("c").alias("times"), F.count(F.lit(1)).alias("replicates"))


def e6_common_times(spark, sf):
    a, b = halves(spark, sf)
    return rounded(merge.merge_on_common_times(a.filter("diffusion_time <= 20"), b.filter("diffusion_time >= 10"), 8))


def e8_pivot(spark, sf):
    return rounded(merge.pivot_trace(trace(spark, sf), list(range(1, 31))))


def e10_null_control(spark, sf):
    return rounded(merge.null_control(trace(spark, sf), 5))


def f1_spectral_dimension(spark, sf):
    return rounded(spectral(spark, sf).select("t", "ds", "r2", "rms"))


def f3_shifted_window(spark, sf):
    return rounded(fits.shifted_dimension(curve(spark, sf), [], "t", "p", 5).select("t", "slope"))


def f4_forward_windows(spark, sf):
    return rounded(fits.forward_windows(curve(spark, sf), [], "t", "p", 6, 2))


def f5_probe_windows(spark, sf):
    return rounded(fits.forward_windows(trace(spark, sf), ["probe_index"], "diffusion_time", V, 8, 4).select("probe_index", "window", "ds", "r2"))


RANGES = [(0, 1, 8), (1, 5, 20), (2, 10, 30)]


def range_fits(spark, sf):
    ranges = spark.createDataFrame(RANGES, "range_id int, x_min int, x_max int")
    return fits.range_fits(trace(spark, sf), ranges, ["probe_index"], "diffusion_time", V)


def f6_range_fits(spark, sf):
    return rounded(range_fits(spark, sf))


def f7_gradient_dimension(spark, sf):
    c = curve(spark, sf).withColumn("se", F.col("p") * F.col("t") * 0.01)
    return rounded(fits.gradient_dimension(c, [], "t", "p", "se").select("t", "ds", "ds_se"))


def f8_gated(spark, sf):
    return rounded(spectral(spark, sf).select("t", fits.gated("ds", "r2", 0.98).alias("ds")))


def f9_fixed_slope(spark, sf):
    return rounded(fits.fixed_slope_amplitude(trace(spark, sf), ["probe_index"], "diffusion_time", V))


def f10_power_law(spark, sf):
    return rounded(fits.power_law(trace(spark, sf), ["probe_index"], "diffusion_time", V))


def f11_window_summary(spark, sf):
    return rounded(fits.window_summary(fits.forward_windows(trace(spark, sf), ["probe_index"], "diffusion_time", V, 8, 4), ["window"]))


def f12_compensated(spark, sf):
    c = merge.time_summary(trace(spark, sf), V)
    return rounded(fits.compensated(c, "diffusion_time", "trace_mean", "trace_se", 5, 15).select("diffusion_time", "compensated", "compensated_se"))


def f13_range_summary(spark, sf):
    return rounded(fits.range_summary(range_fits(spark, sf)))


def f14_plateau(spark, sf):
    return rounded(fits.plateau(boot_spectral(spark, sf), ["b"], "t", "ds", 10))


def g2_bootstrap_means(spark, sf):
    return rounded(boot_means(spark, sf))


def g5_bootstrap_bands(spark, sf):
    return rounded(boots.bands(boot_spectral(spark, sf), ["t"], "ds"))


def g7_agreement(spark, sf):
    return rounded(boots.agreement(boot_spectral(spark, sf), ["t"], "ds", 3.0, 0.1))


def g3_lognormal(spark, sf):
    """Mean over replicates of lognormal curves, relative to the curve: near one."""
    c = merge.time_summary(trace(spark, sf), V).withColumnRenamed("diffusion_time", "t")
    drawn = boots.lognormal_curves(c, 200, "t", "trace_mean", "trace_se", 1).groupBy("t").agg(F.avg("mean").alias("drawn"))
    return c.join(drawn, "t").select("t", (F.col("drawn") / F.col("trace_mean")).alias("ratio"))


def g11_tails(spark, sf):
    p = fits.plateau(boot_spectral(spark, sf), ["b"], "t", "ds", 10)
    return rounded(boots.tail_probabilities(p, [], {"p_mean_ge_3": "plateau_mean >= 3", "p_slope_gt_0": "plateau_slope > 0"}))


def g12_amplitudes(spark, sf):
    b = boot_means(spark, sf).filter("t between 4 and 8").withColumns({"x": F.pow(F.col("t").cast("double"), F.lit(-1.5)), "y": F.col("p")})
    return rounded(boots.replicate_amplitudes(b, "x", "y", 5))


def h1_first_persistent(spark, sf):
    return op.first_persistent(boot_spectral(spark, sf), ["b"], "t", "abs(ds - 3) <= 0.1")


def boot_crossings(spark, sf):
    return op.interpolated_crossing(boot_spectral(spark, sf), ["b"], "t", MARGIN, "r2 >= 0.9")


def h2_interpolated_crossing(spark, sf):
    return rounded(boot_crossings(spark, sf))


def h2_crossing_bands(spark, sf):
    return rounded(boots.bands(boot_crossings(spark, sf), [], "crossing"))


def h4_linear_crossing(spark, sf):
    return rounded(op.interpolated_crossing(boot_spectral(spark, sf), ["b"], "t", "(0.15D - abs(ds - 3D))", "r2 >= 0.9", 2, "linear"))


def h5_central_gates(spark, sf):
    bands = boots.agreement(boot_spectral(spark, sf), ["t"], "ds", 3.0, 0.1)
    c = spectral(spark, sf).join(bands, "t")
    return rounded(op.interpolated_crossing(c, [], "t", "(0.2D - abs(ds - 3D))", "ci_contains_target and r2 >= 0.9", 2))


def h6_persistence_flags(spark, sf):
    return op.persistence_flags(boot_spectral(spark, sf), ["b"], "t", "abs(ds - 3) <= 0.15").select("b", "t", "starts_run", "ends_run")


def h7_downward(spark, sf):
    return rounded(op.downward_crossing(boot_spectral(spark, sf).filter("ds is not null"), ["b"], "t", "ds", 2.97))


def h8_first_at_least(spark, sf):
    c = boot_means(spark, sf).withColumn("y", F.expr("-ln(p)"))
    return rounded(op.first_at_least(c, ["b"], "t", "y", "0.5D"))


def h9_truncation(spark, sf):
    limits = spark.createDataFrame([(t,) for t in (8, 12, 16, 24, 30)], "t_max int")
    return rounded(op.truncated_crossings(boot_spectral(spark, sf), ["b"], "t", limits, MARGIN, "r2 >= 0.9"))


def h9_latest_start(spark, sf):
    return op.latest_start(boot_spectral(spark, sf).filter("ds is not null"), ["b"], "t")


def h10_failure_modes(spark, sf):
    return op.failure_modes(boot_spectral(spark, sf), ["b"], "t", MARGIN)


def h11_probe_crossings(spark, sf):
    f = fits.forward_windows(trace(spark, sf), ["probe_index"], "diffusion_time", V, 8, 1)
    return op.first_persistent(f, ["probe_index"], "window", "abs(ds - 3) <= 0.4", 2)


def h12_first_departure(spark, sf):
    return rounded(op.first_row_where(boot_spectral(spark, sf).select("b", "t", "ds"), ["b"], "t", "abs(ds - 3) > 0.2"))


def h13_sign_change(spark, sf):
    return rounded(op.sign_change(boot_spectral(spark, sf).filter("ds is not null").withColumn("d", F.col("ds") - 3), ["b"], "t", "d"))


QUERIES = {f.__name__: f for f in (
    e2_merge_batches, e3_merge_by_time, e4_time_summary, e5_integrity, e6_common_times, e7_orders, e8_pivot, e9_probe_matrix, g1_drawn_units, e10_null_control,
    f1_spectral_dimension, f3_shifted_window, f4_forward_windows, f5_probe_windows, f6_range_fits, f7_gradient_dimension, f8_gated, f9_fixed_slope, f10_power_law, f11_window_summary, f12_compensated, f13_range_summary, f14_plateau,
    g2_bootstrap_means, g3_lognormal, g5_bootstrap_bands, g7_agreement, g11_tails, g12_amplitudes,
    h1_first_persistent, h2_interpolated_crossing, h2_crossing_bands, h4_linear_crossing, h5_central_gates, h6_persistence_flags, h7_downward, h8_first_at_least, h9_truncation, h9_latest_start, h10_failure_modes, h11_probe_crossings, h12_first_departure, h13_sign_change,
)}


def forward(source: str, keys: list[str], x: str, y: str, width: int, stride: int) -> str:
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    own = ", ".join([*keys, ""]) if keys else ""
    return f"""forward AS (
      SELECT {own}win AS "window", x_mean, x_first, x_last, ds, r2 FROM (
        SELECT {own}row_number() OVER ({by}ORDER BY x) - 1 AS win, count(lx + ly) OVER w AS n, exp(avg(lx) OVER w) AS x_mean, min(x) OVER w AS x_first, max(x) OVER w AS x_last, -2 * regr_slope(ly, lx) OVER w AS ds, regr_r2(ly, lx) OVER w AS r2
        FROM (SELECT {own}{x} AS x, ln({x}::DOUBLE) AS lx, ln({y}) AS ly FROM {source})
        WINDOW w AS ({by}ORDER BY x ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)) WHERE n = {width} AND win % {stride} = 0)"""


FITTED = f"""{TRACE}, ranges AS (SELECT * FROM (VALUES {", ".join(map(str, RANGES))}) r(range_id, x_min, x_max)), fitted AS (
  SELECT range_id, probe_index, count(*) AS n, -2 * regr_slope(ly, lx) AS ds, 2 * sqrt(greatest(0, regr_syy(ly, lx) - pow(regr_sxy(ly, lx), 2) / regr_sxx(ly, lx)) / (count(*) - 2) / regr_sxx(ly, lx)) AS ds_se, regr_r2(ly, lx) AS r2
  FROM (SELECT *, ln(diffusion_time::DOUBLE) AS lx, ln({V}) AS ly FROM trace JOIN ranges ON diffusion_time BETWEEN x_min AND x_max) GROUP BY 1, 2 HAVING count(*) >= 3)"""
PROBE_FORWARD = f"{TRACE}, {forward('trace', ['probe_index'], 'diffusion_time', V, 8, 4)}"
SUMMARY = f"summary AS (SELECT diffusion_time, count(*) AS n, avg({V}) AS m, stddev_samp({V}) AS s FROM trace GROUP BY 1)"
PLATEAU = f"plateau AS (SELECT b, count(*) AS n_late, CASE WHEN count(*) >= 3 THEN avg(ds) END AS plateau_mean, CASE WHEN count(*) >= 3 THEN regr_slope(ds, ln(t::DOUBLE)) END AS plateau_slope FROM bs WHERE t >= 10 AND ds IS NOT NULL GROUP BY b)"
SHIFT = "WINDOW w AS (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
GRAD_IN = "((lx - l1) * (lx - l1) * yn - (xn - lx) * (xn - lx) * y1 + ((xn - lx) * (xn - lx) - (lx - l1) * (lx - l1)) * ly) / ((lx - l1) * (xn - lx) * (xn - l1))"


def side(x1: str, y1: str, x2: str, y2: str) -> str:
    """Derivative at lx of the parabola through three points."""
    return f"(ly * ((lx - {x1}) + (lx - {x2})) / ((lx - {x1}) * (lx - {x2})) + {y1} * (lx - {x2}) / (({x1} - lx) * ({x1} - {x2})) + {y2} * (lx - {x1}) / (({x2} - lx) * ({x2} - {x1})))"


LEAD = "lead({0}) OVER (PARTITION BY b ORDER BY t)"
BS = f"WITH {BOOT_SPECTRAL}"
KNOWN = "SELECT b, t, ds, " + LEAD.format("ds") + " AS nds, " + LEAD.format("t") + " AS nt FROM bs WHERE ds IS NOT NULL"
ORACLE_SQL = {
    "e2_merge_batches": f"WITH {TRACE} SELECT (probe_index % 8)::INT AS local_probe_index, diffusion_time, round({V}, 6) AS {V}, (probe_index // 8)::INT AS batch, probe_index FROM trace",
    "e3_merge_by_time": f"WITH {TRACE} SELECT diffusion_time, count(*) AS n, round(avg({V}), 6) AS mean FROM trace WHERE (probe_index < 8) = (diffusion_time <= 15) GROUP BY 1",
    "e4_time_summary": f"WITH {TRACE}, {SUMMARY} SELECT diffusion_time, n AS n_probes, round(m, 6) AS trace_mean, round(s, 6) AS trace_std, round(s / sqrt(n), 6) AS trace_se, round(m / 100, 6) AS p_return, round(s / sqrt(n) / 100, 6) AS p_return_se, round(s / sqrt(n) / m, 6) AS relative_se FROM summary",
    "e5_integrity": f"WITH {TRACE} SELECT count(*) AS n_rows, count(DISTINCT (probe_index, diffusion_time)) AS n_cells, 0::BIGINT AS n_repeated, (SELECT min(n) FROM (SELECT count(*) AS n FROM trace GROUP BY probe_index)) AS min_per_probe, count(DISTINCT probe_index) AS n_probes, min(probe_index) AS first_probe, max(probe_index) AS last_probe, (SELECT min(n) FROM (SELECT count(*) AS n FROM trace GROUP BY diffusion_time)) AS min_per_time, count(DISTINCT diffusion_time) AS n_times FROM trace",
    "e6_common_times": f"WITH {TRACE} SELECT probe_index, diffusion_time, round({V}, 6) AS {V} FROM trace WHERE diffusion_time BETWEEN 10 AND 20",
    "e7_orders": f"WITH {TRACE} SELECT probe_index, diffusion_time, round({V}, 6) AS {V}, row_number() OVER (ORDER BY probe_index, diffusion_time) - 1 AS by_probe, row_number() OVER (ORDER BY diffusion_time, probe_index) - 1 AS by_time FROM trace",
    "e9_probe_matrix": f"WITH {TRACE} SELECT probe_index, count(*) AS n, round(sum({V}), 6) AS total, true AS refused FROM trace GROUP BY 1",
    "g1_drawn_units": f"WITH {BOOT} SELECT unit, sum(c)::BIGINT AS times, count(*) AS replicates FROM draws WHERE unit IN (SELECT probe_index FROM trace) GROUP BY 1",
    "e8_pivot": f"WITH {TRACE} SELECT probe_index, " + ", ".join(f"round(max({V}) FILTER (diffusion_time = {t}), 6) AS t{t}" for t in range(1, 31)) + " FROM trace GROUP BY 1",
    "e10_null_control": f"WITH {TRACE}, {SUMMARY} SELECT probe_index, diffusion_time, round({V} / m * (SELECT m FROM summary WHERE diffusion_time = 5) * pow(diffusion_time / 5.0::DOUBLE, -1.5), 6) AS {V} FROM trace JOIN summary USING (diffusion_time)",
    "f1_spectral_dimension": f"WITH {SPECTRAL} SELECT t, round(ds, 6) AS ds, round(r2, 6) AS r2, round(rms, 6) AS rms FROM spectral",
    "f3_shifted_window": f"""WITH {CURVE}, s AS (SELECT t, CASE WHEN count(*) OVER w = 5 THEN regr_slope(ln(p), ln(t::DOUBLE)) OVER w END AS s, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n FROM curve {SHIFT})
      SELECT t, round(coalesce(s, CASE WHEN i < 3 THEN (SELECT s FROM s WHERE i = 3) ELSE (SELECT s FROM s WHERE i = n - 2) END), 6) AS slope FROM s""",
    "f4_forward_windows": f'WITH {CURVE}, {forward("curve", [], "t", "p", 6, 2)} SELECT "window", round(x_mean, 6) AS x_mean, x_first, x_last, round(ds, 6) AS ds, round(r2, 6) AS r2 FROM forward',
    "f5_probe_windows": f'WITH {PROBE_FORWARD} SELECT probe_index, "window", round(ds, 6) AS ds, round(r2, 6) AS r2 FROM forward',
    "f6_range_fits": f"WITH {FITTED} SELECT range_id, probe_index, n, round(ds, 6) AS ds, round(ds_se, 6) AS ds_se, round(r2, 6) AS r2 FROM fitted",
    "f7_gradient_dimension": f"""WITH {CURVE}, l AS (SELECT t, ln(t::DOUBLE) AS lx, ln(p) AS ly, t * 0.01::DOUBLE AS r FROM curve), g AS (
        SELECT *, lag(lx) OVER w AS l1, lag(ly) OVER w AS y1, lag(lx, 2) OVER w AS l2, lag(ly, 2) OVER w AS y2, lead(lx) OVER w AS xn, lead(ly) OVER w AS yn, lead(lx, 2) OVER w AS xm, lead(ly, 2) OVER w AS ym, coalesce(lag(r) OVER w, r) AS ra, coalesce(lead(r) OVER w, r) AS rb FROM l WINDOW w AS (ORDER BY lx))
      SELECT t, round(-2 * CASE WHEN l1 IS NULL THEN {side("xn", "yn", "xm", "ym")} WHEN xn IS NULL THEN {side("l1", "y1", "l2", "y2")} ELSE {GRAD_IN} END, 6) AS ds, round(2 * sqrt(ra * ra + rb * rb) / (coalesce(xn, lx) - coalesce(l1, lx)), 6) AS ds_se FROM g""",
    "f8_gated": f"WITH {SPECTRAL} SELECT t, round(CASE WHEN r2 >= 0.98 THEN ds END, 6) AS ds FROM spectral",
    "f9_fixed_slope": f"WITH {TRACE} SELECT probe_index, round(exp(avg(ln({V}) + 1.5 * ln(diffusion_time::DOUBLE))), 6) AS amplitude FROM trace GROUP BY 1",
    "f10_power_law": f"WITH {TRACE} SELECT probe_index, round(regr_slope(ln({V}), ln(diffusion_time::DOUBLE)), 6) AS exponent, round(exp(regr_intercept(ln({V}), ln(diffusion_time::DOUBLE))), 6) AS amplitude, round(regr_r2(ln({V}), ln(diffusion_time::DOUBLE)), 6) AS r2 FROM trace GROUP BY 1",
    "f11_window_summary": f'WITH {PROBE_FORWARD} SELECT "window", count(*) AS n, round(avg(ds), 6) AS ds_mean, round(quantile_cont(ds, 0.5), 6) AS ds_median, round(stddev_samp(ds), 6) AS ds_std, round(stddev_samp(ds) / sqrt(count(*)), 6) AS ds_sem, round(quantile_cont(ds, 0.16), 6) AS ds_q16, round(quantile_cont(ds, 0.84), 6) AS ds_q84, round(avg(r2), 6) AS r2_mean, round(min(r2), 6) AS r2_min FROM forward GROUP BY 1',
    "f12_compensated": f"WITH {TRACE}, {SUMMARY}, c AS (SELECT *, m * pow(diffusion_time, 1.5) AS c, s / sqrt(n) * pow(diffusion_time, 1.5) AS e FROM summary), r AS (SELECT quantile_cont(c, 0.5) AS r FROM c WHERE diffusion_time BETWEEN 5 AND 15) SELECT diffusion_time, round(c / r, 6) AS compensated, round(e / r, 6) AS compensated_se FROM c, r",
    "f13_range_summary": f"WITH {FITTED}, s AS (SELECT range_id, count(*) AS n_probes, avg(ds) AS m, stddev_samp(ds) / sqrt(count(*)) AS e FROM fitted GROUP BY 1) SELECT range_id, n_probes, round(m, 6) AS ds_mean, round(e, 6) AS ds_sem, abs(m - 3) <= e AS within_1_sem, abs(m - 3) <= 2 * e AS within_2_sem FROM s",
    "f14_plateau": f"{BS}, {PLATEAU} SELECT b, n_late, round(plateau_mean, 6) AS plateau_mean, round(plateau_slope, 6) AS plateau_slope FROM plateau",
    "g2_bootstrap_means": f"WITH {BOOT} SELECT b, t, round(p, 6) AS p FROM boot",
    "g5_bootstrap_bands": f"{BS} SELECT t, {quantiles('ds')}, round(avg(ds), 6) AS mean, round(stddev_samp(ds), 6) AS std, count(ds) AS n, round(count(ds) / count(*), 6) AS success FROM bs GROUP BY t",
    "g7_agreement": f"{BS} SELECT t, round(avg(CASE WHEN abs(ds - 3) <= 0.1 THEN 1 ELSE 0 END), 6) AS probability_within, coalesce(quantile_cont(ds, 0.025) <= 3 AND quantile_cont(ds, 0.975) >= 3, false) AS ci_contains_target FROM bs GROUP BY t",
    "g11_tails": f"{BS}, {PLATEAU} SELECT round(avg((plateau_mean >= 3)::INT), 6) AS p_mean_ge_3, round(avg((plateau_slope > 0)::INT), 6) AS p_slope_gt_0 FROM plateau",
    "g12_amplitudes": f"WITH {BOOT} SELECT b, round(sum(p * pow(t, -1.5)) / sum(pow(t, -3)), 6) AS amplitude FROM boot WHERE t BETWEEN 4 AND 8 GROUP BY b HAVING count(*) = 5",
    "h1_first_persistent": f"{BS} SELECT b, min(t) FILTER (run) AS crossing FROM (SELECT b, t, {persistent('abs(ds - 3) <= 0.1', 't', ['b'])} AS run FROM bs) GROUP BY b",
    "h2_interpolated_crossing": f"{BS}, c AS ({crossing('bs', ['b'], 't', DUCK_MARGIN, 'r2 >= 0.9')}) SELECT b, round(crossing, 6) AS crossing FROM c",
    "h2_crossing_bands": f"{BS}, c AS ({crossing('bs', ['b'], 't', DUCK_MARGIN, 'r2 >= 0.9')}) SELECT {quantiles('crossing')}, round(avg(crossing), 6) AS mean, round(stddev_samp(crossing), 6) AS std, count(crossing) AS n, round(count(crossing) / count(*), 6) AS success FROM c",
    "h4_linear_crossing": f"{BS}, c AS ({crossing('bs', ['b'], 't', '(0.15 - abs(ds - 3))', 'r2 >= 0.9', 'linear', n=2)}) SELECT b, round(crossing, 6) AS crossing FROM c",
    "h5_central_gates": f"WITH {BOOT_SPECTRAL}, ci AS (SELECT t, quantile_cont(ds, 0.025) <= 3 AND quantile_cont(ds, 0.975) >= 3 AS good FROM bs GROUP BY t), curve AS (SELECT diffusion_time AS t, avg({V}) AS p FROM trace GROUP BY 1), {windowed('curve', [], 't', 'p', 7)}, j AS (SELECT * FROM spectral JOIN ci USING (t)), c AS ({crossing('j', [], 't', '(0.2 - abs(ds - 3))', 'good AND r2 >= 0.9', n=2)}) SELECT round(crossing, 6) AS crossing FROM c",
    "h6_persistence_flags": f"{BS} SELECT b, t, {persistent('abs(ds - 3) <= 0.15', 't', ['b'])} AS starts_run, (min(coalesce((abs(ds - 3) <= 0.15)::INT, 0)) OVER w = 1 AND count(*) OVER w = 3) AS ends_run FROM bs WINDOW w AS (PARTITION BY b ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "h7_downward": f"{BS} SELECT b, round(min(t + (nt - t) * (2.97 - ds) / (nds - ds)), 6) AS crossing FROM ({KNOWN}) WHERE ds > 2.97 AND nds <= 2.97 GROUP BY b",
    "h8_first_at_least": f"WITH {BOOT} SELECT b, round(min_by(CASE WHEN pt IS NULL OR y = py THEN t ELSE pt + (t - pt) * (0.5 - py) / (y - py) END, t), 6) AS crossing FROM (SELECT b, t, -ln(p) AS y, lag(-ln(p)) OVER w AS py, lag(t) OVER w AS pt FROM boot WINDOW w AS (PARTITION BY b ORDER BY t)) WHERE y >= 0.5 GROUP BY b",
    "h9_truncation": f"{BS}, cut AS (SELECT * FROM bs JOIN (SELECT unnest([8, 12, 16, 24, 30])::INT AS t_max) ON t <= t_max), c AS ({crossing('cut', ['t_max', 'b'], 't', DUCK_MARGIN, 'r2 >= 0.9')}) SELECT t_max, b, round(crossing, 6) AS crossing FROM c",
    "h9_latest_start": f"{BS} SELECT b, max(t) FILTER (n = 3) AS latest_start FROM (SELECT b, t, count(*) OVER (PARTITION BY b ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM bs WHERE ds IS NOT NULL) GROUP BY b",
    "h10_failure_modes": f"{BS} SELECT b, count(ds) AS n_known, count(*) FILTER (abs(ds - 3) <= 0.1) AS n_inside, CASE WHEN max(run::INT) = 1 THEN 'crosses' WHEN count(ds) < 3 THEN 'insufficient' WHEN count(*) FILTER (abs(ds - 3) <= 0.1) = 0 THEN 'never_enters' ELSE 'not_persistent' END AS mode FROM (SELECT *, {persistent('abs(ds - 3) <= 0.1', 't', ['b'])} AS run FROM bs) GROUP BY b",
    "h11_probe_crossings": f'WITH {TRACE}, {forward("trace", ["probe_index"], "diffusion_time", V, 8, 1)}, f AS (SELECT probe_index, "window" AS k, ds FROM forward) SELECT probe_index, min(k) FILTER (run) AS crossing FROM (SELECT *, {persistent("abs(ds - 3) <= 0.4", "k", ["probe_index"], 2)} AS run FROM f) GROUP BY 1',
    "h12_first_departure": f"{BS} SELECT b, min(t) AS t, round(min_by(ds, t), 6) AS ds FROM bs WHERE abs(ds - 3) > 0.2 GROUP BY b",
    "h13_sign_change": f"{BS} SELECT b, round(min(CASE WHEN ds = 3 THEN t ELSE t + (nt - t) * (3 - ds) / (nds - ds) END), 6) AS crossing FROM ({KNOWN}) WHERE ds = 3 OR (ds - 3) * (nds - 3) < 0 GROUP BY b",
}
