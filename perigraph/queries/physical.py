"""Length, metric, density, spectrum, prediction and control queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometric_grid
from ..operators import bootstrap as boots
from ..operators import density, fits, heatkernel, length, metric, spatial, spectrum, synthetic
from ..operators import crossing as cross
from ..session import materialize
from .fixtures import BOX, CURVE, REPLICATES, POINTS, SPECTRAL, curve, d2, persistent, points, rounded, table
from .selection import pair_list

TAU = 2 * math.pi / BOX
M = 8
VOLUME = BOX**3


def decay(spark, sf):
    """diffusion_time, n2, k2, correlation, sigma from the events."""
    e = table(spark, sf, "events").filter("value > 0").groupBy(F.dayofmonth("ts").alias("diffusion_time"), (F.col("user_id") % 4 + 1).alias("n2")).agg(F.avg("value").alias("v"))
    e = e.withColumn("k2", F.col("n2") * (TAU * TAU)).withColumn("correlation", F.exp(-F.col("k2") * F.col("diffusion_time") * (5 + F.col("v") / 100)))
    return e.withColumn("sigma", F.col("correlation") * 0.01 * F.col("n2"))


DECAY = f"""decay AS (SELECT *, correlation * 0.01::DOUBLE * n2 AS sigma FROM (SELECT *, exp(-k2 * diffusion_time * (5 + v / 100)) AS correlation FROM (
  SELECT day(ts)::INT AS diffusion_time, user_id % 4 + 1 AS n2, (user_id % 4 + 1) * {TAU * TAU!r}::DOUBLE AS k2, avg(value) AS v FROM events WHERE value > 0 GROUP BY 1, 2, 3)))"""


def lengths(spark, sf):
    return decay(spark, sf).filter("n2 = 1").select("diffusion_time", (F.sqrt(F.col("diffusion_time").cast("double")) * (6 + F.col("v") / 100)).alias("length"))


LENGTHS = f"{DECAY}, lengths AS (SELECT diffusion_time, sqrt(diffusion_time) * (6 + v / 100) AS length FROM decay WHERE n2 = 1)"


def i4_shell_length(spark, sf):
    return rounded(length.shell_length(decay(spark, sf), ["diffusion_time"], 0.05))


def i5_pooled_diffusivity(spark, sf):
    return rounded(length.pooled_diffusivity(decay(spark, sf), [], 2, 20, 4))


def i6_mode_diffusivity(spark, sf):
    return rounded(length.pooled_diffusivity(decay(spark, sf), ["n2"], 2, 20, 4))


def i7_radius(spark, sf):
    t = F.col("t").cast("double")
    return rounded(curve(spark, sf).select("t", length.radius_of(t, 10.4).alias("radius"), length.calibration_error(t, 0.02).alias("error")))


def i9_lengths_at(spark, sf):
    times = spark.range(0, 70).select((F.col("id") / 2).alias("t"))
    return rounded(length.lengths_at(times, lengths(spark, sf)))


def i10_merge_lengths(spark, sf):
    own = lengths(spark, sf)
    return rounded(length.merge_lengths(own.filter("diffusion_time <= 20"), own.filter("diffusion_time >= 15").withColumn("length", F.col("length") + 1)))


def i11_with_lengths(spark, sf):
    spectral = fits.centred_dimension(curve(spark, sf), [], "t", "p", 7).select(F.col("t").alias("diffusion_time"), "ds")
    return rounded(length.with_lengths(spectral, lengths(spark, sf), tolerance=0.1).withColumn("in_band", F.coalesce("in_band", F.lit(False))))


def containment_bins(spark, sf):
    r, d = F.col("user_id") % 30 + 1, F.dayofmonth("ts") % 4 + 1
    e = table(spark, sf, "events").groupBy(d.alias("diffusion_time"), r.cast("double").alias("r")).agg(F.count(F.lit(1)).alias("pair_count"), F.avg(F.abs("value")).alias("v"))
    return e.select("diffusion_time", "r", "pair_count", ((1 - F.exp(-F.col("r") / (3.0 + F.col("diffusion_time")))) * (1 + F.col("v") / 10000)).alias("median"))


BINS = """bins AS (SELECT diffusion_time, r, pair_count, (1 - exp(-r / (3.0 + diffusion_time))) * (1 + v / 10000) AS median FROM (
  SELECT day(ts)::INT % 4 + 1 AS diffusion_time, (user_id % 30 + 1)::DOUBLE AS r, count(*) AS pair_count, avg(abs(value)) AS v FROM events GROUP BY 1, 2))"""


def i12_containment(spark, sf):
    return rounded(length.containment_lengths(containment_bins(spark, sf), [0.4, 0.5, 0.6], min_pairs=20))


def i13_origin_fit(spark, sf):
    x = lengths(spark, sf).withColumn("x", F.sqrt(F.col("diffusion_time").cast("double")))
    return rounded(fits.origin_fit(x, [], "x", "length").select("n", "slope", "slope_se", "r2", "rmse", "relative_rmse"))


def i14_prefactor(spark, sf):
    x = lengths(spark, sf).withColumn("x", F.sqrt(F.col("diffusion_time").cast("double")))
    return rounded(length.prefactor_summary(x, "x", "length"))


def i17_adopted(spark, sf):
    """The preferred label is not there, so the median over the modes' calibrations is adopted."""
    per_mode = length.pooled_diffusivity(decay(spark, sf), ["n2"], 2, 20, 4)
    return rounded(length.adopted_calibration(per_mode.select(F.lit("sweep").alias("kind"), F.col("n2").cast("string").alias("label"), F.col("a_rms").alias("a")), "none"))


def i16_merged_harmonics(spark, sf):
    """Tables of two harmonics each, merged where every time has all, and fitted again."""
    d = decay(spark, sf)
    parts = [d.filter(c).withColumn("harmonic", F.col("n2").cast("int")) for c in ("n2 <= 2", "n2 > 2")]
    return rounded(length.pooled_diffusivity(length.merged_harmonics(parts, [1, 2, 3, 4]), [], 2, 20, 4))


def i18_sensitivity(spark, sf):
    per_mode = length.pooled_diffusivity(decay(spark, sf), ["n2"], 2, 20, 4).withColumnRenamed("a_rms", "a")
    return rounded(length.sensitivity(per_mode))


def measured(spark, sf):
    p = pair_list(spark, sf)
    return p.withColumn("y", F.col("distance") * (0.02 + 0.002 * F.sin(F.col("id_i").cast("double")))).withColumn("w", 1.0 + F.col("id_i") % 3)


MEASURED = f"""{POINTS}, measured AS (SELECT *, distance * (0.02 + 0.002 * sin(id_i::DOUBLE)) AS y, 1.0::DOUBLE + id_i % 3 AS w FROM (
  SELECT a.id AS id_i, b.id AS id_j, sqrt({d2("a", "b")}) AS distance FROM points a JOIN points b ON b.id = (a.id * 37) % (SELECT count(*) FROM points) + 1 AND a.id <> b.id))"""


def j2_binned_curve(spark, sf):
    return rounded(metric.binned_curve(measured(spark, sf), [], "distance", "y", 20.0, 5.0, 10))


def j3_linearity(spark, sf):
    return rounded(metric.linearity(metric.binned_curve(measured(spark, sf), [], "distance", "y", 20.0, 5.0, 10), [], 5))


def j4_weighted_bins(spark, sf):
    return rounded(metric.weighted_bins(measured(spark, sf), [], metric.linear_bin(F.col("distance"), 20.0, 10.0, 5), "distance", "y", "w"))


def j4_log_bins(spark, sf):
    return rounded(metric.weighted_bins(measured(spark, sf), [], metric.log_bin(F.col("distance"), 10.0, 80.0, 6), "distance", "y", "w").select("bin", "n", "y_mean"))


def j5_identity(spark, sf):
    return rounded(metric.identity_metrics(measured(spark, sf).withColumn("y", F.col("y") * 50), [], "distance", "y"))


RADII = geometric_grid(5.0, 30.0, 8)


def centre_counts(spark, sf, drawn=None):
    """Counts around all points, or around those that some replicate has drawn, numbered from 0."""
    p = points(spark, sf)
    centres = p if drawn is None else p.join(drawn.select((F.col("unit").cast("long") + 1).alias("id")).distinct(), "id", "left_semi")
    return spatial.counts_in_spheres(centres, p, RADII, BOX, 8).withColumn("center", F.col("center") - 1)


COUNTS = f"""{POINTS}, radii AS (SELECT unnest([{", ".join(map(repr, RADII))}])::DOUBLE AS radius), near AS (
  SELECT a.id, radius, count(*) AS n FROM points a JOIN points b ON a.id <> b.id JOIN radii ON {d2("a", "b")} <= radius * radius GROUP BY 1, 2), counts AS (
  SELECT (c.id - 1)::INT AS center, radii.radius, coalesce(n, 0) AS count FROM points c CROSS JOIN radii LEFT JOIN near ON near.id = c.id AND near.radius = radii.radius)"""


def shifted(source: str, keys: list[str], name: str) -> str:
    """Shifted windows of 5 of ln mean on ln radius in SQL: source with d2."""
    by = f"PARTITION BY {', '.join(keys)}" if keys else ""
    w = f"OVER ({by} ORDER BY radius ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    return f"""{name}_raw AS (SELECT *, row_number() OVER ({by} ORDER BY radius) AS i, count(*) OVER ({by}) AS n, CASE WHEN count(lm) {w} = 5 THEN regr_slope(lm, ln(radius)) {w} END AS s
        FROM (SELECT *, CASE WHEN mean > 0 THEN ln(mean) END AS lm FROM {source})),
      {name} AS (SELECT *, CASE WHEN i < 3 THEN max(s) FILTER (i = 3) OVER ({by}) WHEN i > n - 2 THEN max(s) FILTER (i = n - 2) OVER ({by}) ELSE s END AS d2 FROM {name}_raw)"""


def number_density(spark, sf) -> float:
    return points(spark, sf).count() / VOLUME


def k5_density_curve(spark, sf):
    return rounded(density.density_curve(centre_counts(spark, sf), number_density(spark, sf)))


def k6_joint_criterion(spark, sf):
    c = density.with_joint_margin(density.density_curve(centre_counts(spark, sf), number_density(spark, sf)), 0.1, 0.3)
    return cross.persistence_flags(c, [], "radius", "margin >= 0", 3).select(F.round("radius", 6).alias("radius"), F.round("margin", 6).alias("margin"), "starts_run")


def k7_bootstrap_scales(spark, sf):
    drawn = materialize(boots.multiplicities(boots.lattice_draws(spark, REPLICATES, points(spark, sf).count())), "drawn")
    return rounded(density.bootstrap_scales(centre_counts(spark, sf, drawn), drawn, number_density(spark, sf), 5, 2, 0.2, 0.4))


EXPECTED = f"((SELECT count(*) FROM points) / 1e6::DOUBLE * 4 * pi() / 3 * pow(radius, 3))"
DENSITY = f"{COUNTS}, means AS (SELECT radius, avg(count) AS mean FROM counts GROUP BY 1), {shifted('means', [], 'dense')}"


def l1_mesh_counts(spark, sf):
    return spectrum.nearest_grid_counts(points(spark, sf), BOX, M)


def contrast(spark, sf):
    p = points(spark, sf)
    return spectrum.density_contrast(spectrum.nearest_grid_counts(p, BOX, M), M, p.count())


def l2_contrast(spark, sf):
    return rounded(contrast(spark, sf))


def l3_transform(spark, sf):
    return rounded(spectrum.completed(spectrum.real_transform(contrast(spark, sf), M, 4 * M), M), 5)


def l3_transform_by_sums(spark, sf):
    return rounded(spectrum.transform_by_sums(contrast(spark, sf), M), 5)


def shells(spark, sf):
    return spectrum.shell_spectrum(spectrum.real_transform(contrast(spark, sf), M), BOX, M, points(spark, sf).count(), half=True)


def l5_shell_spectrum(spark, sf):
    return rounded(shells(spark, sf))


def l7_linear_bins(spark, sf):
    return rounded(spectrum.linear_bins(shells(spark, sf), 0.1))


def l8_compare_shells(spark, sf):
    target = spectrum.shell_geometry(spark, 4).select("n2", (1000.0 / F.col("n2")).alias("p"))
    return rounded(spectrum.compare_shells(shells(spark, sf), target))


def l5_shell_geometry(spark, sf):
    """Modes of each complete shell, beside those that the transform of the points has."""
    measured = shells(spark, sf).select("n2", F.col("n_modes").alias("measured"))
    return spectrum.shell_geometry(spark, M // 2 - 1).join(measured, "n2", "left")


#: Catalogues: all points, and two choices of them.
CATALOGUES = {"every": "true", "even": "id % 2 = 0", "third": "id % 3 = 0"}


def catalogue(spark, sf, name):
    """Shell spectrum (n2, k, p, n_modes) of a catalogue's points."""
    chosen = points(spark, sf).filter(CATALOGUES[name])
    n = chosen.count()
    field = spectrum.density_contrast(spectrum.nearest_grid_counts(chosen, BOX, M), M, n)
    return spectrum.shell_spectrum(spectrum.real_transform(field, M), BOX, M, n, half=True).select("n2", "k", F.col("p_raw").alias("p"), "n_modes")


def linear_table(spark, sf):
    """A spectrum (k, p) from the curve of the events, days standing for wave numbers."""
    return curve(spark, sf).select((0.05 * F.pow(F.lit(1.09), F.col("t").cast("double"))).alias("k"), (1e4 * F.col("p")).alias("p"))


GRID = [10.0, 14.0, 20.0, 27.0, 40.0, 55.0]
def m1_filtered_variance(spark, sf):
    return rounded(heatkernel.filtered_variance(catalogue(spark, sf, "every"), heatkernel.radius_grid(spark, GRID), VOLUME))


def m2_log_derivatives(spark, sf):
    v = heatkernel.filtered_variance(catalogue(spark, sf, "every"), heatkernel.radius_grid(spark, GRID), VOLUME)
    return rounded(heatkernel.log_derivatives(v).select("radius", "x", "gamma"))


def m3_interpolate(spark, sf):
    v = heatkernel.filtered_variance(catalogue(spark, sf, "every"), heatkernel.radius_grid(spark, GRID), VOLUME)
    at = spark.range(1, 15).select((F.col("id") * 4.5).alias("at"))
    return rounded(heatkernel.interpolate_at(at, v, "radius", "sigma2"))


def m3_long_curve(spark, sf):
    prices = table(spark, sf, "part").select((F.col("p_retailprice").cast("double") + F.col("p_partkey") / 1000000).alias("price"), (F.col("p_size") + F.col("p_partkey") % 10 / 10).alias("size"))
    at = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("at"))
    return rounded(heatkernel.interpolate_at(at, prices, "price", "size"))


def m4_contributions(spark, sf):
    return rounded(heatkernel.shell_contributions(catalogue(spark, sf, "every"), 20.0))


def m6_weighted_fit(spark, sf):
    s = fits.centred_dimension(curve(spark, sf), [], "t", "p", 7).filter("ds is not null").selectExpr("1 / cast(t as double) as x", "ds - 3 as y", "cast(t as double) as w")
    return rounded(fits.origin_fit(s, [], "x", "y", "w"))


def m8_filtered_ratio(spark, sf):
    return rounded(heatkernel.filtered_ratio(catalogue(spark, sf, "every"), catalogue(spark, sf, "even"), heatkernel.radius_grid(spark, GRID), VOLUME))


def m9_three_way(spark, sf):
    first = heatkernel.same_geometry(catalogue(spark, sf, "every"), catalogue(spark, sf, "even"))
    return rounded(heatkernel.power_ratios(first, {"b": catalogue(spark, sf, "even"), "c": catalogue(spark, sf, "third")}))


BANDS = [("low", 0.0, 0.2), ("mid", 0.1, 0.3), ("all", 0.0, 1.0)]


def m10_band_summary(spark, sf):
    ratios = heatkernel.power_ratios(catalogue(spark, sf, "every"), {"b": catalogue(spark, sf, "even")}).withColumnRenamed("ratio_b", "ratio")
    return rounded(heatkernel.band_summary(ratios, spark.createDataFrame(BANDS, "band string, k_lo double, k_hi double")))


def m12_bias(spark, sf):
    return rounded(heatkernel.bias(catalogue(spark, sf, "every"), linear_table(spark, sf)).select("n2", "p_lin", "bias"))


def m12_effective_bias(spark, sf):
    return rounded(heatkernel.effective_bias(heatkernel.bias(catalogue(spark, sf, "every"), linear_table(spark, sf)), 20.0))


def n3_mode_powers(spark, sf):
    return rounded(synthetic.mode_powers(linear_table(spark, sf), M, BOX))


def n2_mode_powers_linear(spark, sf):
    return rounded(synthetic.mode_powers(linear_table(spark, sf), M, BOX, "linear"))


def n5_mesh_at_points(spark, sf):
    return rounded(synthetic.mesh_at_points(points(spark, sf), contrast(spark, sf), M, BOX))


def n1_recovered_density(spark, sf):
    """A Gaussian field, its displacement, and the field recovered from it: their largest difference is near zero."""
    modes = synthetic.coloured_modes(synthetic.white_noise(spark, M, 3), synthetic.mode_powers(linear_table(spark, sf), M, BOX), M, BOX)
    half = F.expr(" or ".join(f"i{c} = {M // 2}" for c in "xyz"))
    modes = modes.withColumns({c: F.when(half, 0.0).otherwise(F.col(c)) for c in ("re", "im")})
    fields = {c: synthetic.real_part(spectrum.transform(synthetic.displacement_modes(modes, c, M, BOX), M, inverse=True)) for c in "xyz"}
    again = synthetic.density_from_displacement(fields, M, BOX).withColumnRenamed("v", "again")
    joined = synthetic.density_field(modes, M).join(again, ["ix", "iy", "iz"])
    return joined.agg(F.max(F.abs(F.col("v") - F.col("again"))).alias("largest_difference"), F.stddev_pop("v").alias("std"))


def n6_displaced(spark, sf):
    fields = {c: contrast(spark, sf) for c in "xyz"}
    return synthetic.displaced(synthetic.uniform_points(spark, 500, BOX, 1), fields, M, BOX)


def n7_sampled_cells(spark, sf):
    weights = synthetic.biased_weights(contrast(spark, sf), 1.0)
    return synthetic.jittered(synthetic.sampled_cells(weights, 2000, M, 5), M, BOX, 5)


def n7_weights(spark, sf):
    return rounded(synthetic.biased_weights(contrast(spark, sf), 1.5).withColumn("p", F.col("p") * 1000))


def n9_float_wrap(spark, sf):
    """Places just below the box's end, in single precision: those that round up to the end wrap."""
    return points(spark, sf).select("id", synthetic.as_float(BOX - F.col("x") * 1e-7, BOX).alias("x"))


def n8_field_statistics(spark, sf):
    return rounded(synthetic.field_statistics(contrast(spark, sf)))


def n8_effective_cells(spark, sf):
    return rounded(synthetic.effective_cells(synthetic.biased_weights(contrast(spark, sf), 1.0)))


QUERIES = {f.__name__: f for f in (
    i4_shell_length, i5_pooled_diffusivity, i6_mode_diffusivity, i7_radius, i9_lengths_at, i10_merge_lengths, i11_with_lengths, i12_containment, i13_origin_fit, i14_prefactor, i16_merged_harmonics, i17_adopted, i18_sensitivity,
    j2_binned_curve, j3_linearity, j4_weighted_bins, j4_log_bins, j5_identity, k5_density_curve, k6_joint_criterion, k7_bootstrap_scales,
    l1_mesh_counts, l2_contrast, l3_transform, l3_transform_by_sums, l5_shell_spectrum, l5_shell_geometry, l7_linear_bins, l8_compare_shells,
    m1_filtered_variance, m2_log_derivatives, m3_interpolate, m3_long_curve, m4_contributions, m6_weighted_fit, m8_filtered_ratio, m9_three_way, m10_band_summary, m12_bias, m12_effective_bias,
    n1_recovered_density, n2_mode_powers_linear, n3_mode_powers, n5_mesh_at_points, n6_displaced, n7_sampled_cells, n7_weights, n9_float_wrap, n8_field_statistics, n8_effective_cells,
)}



def origin(source: str, x: str, y: str, keys: str = "", w: str = "1.0") -> str:
    """Through-origin sums of source in SQL, then the fit's numbers."""
    own, by = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""(SELECT *, sxy / sxx AS a, greatest(0, syy - 2 * (sxy / sxx) * sxy + (sxy / sxx) * (sxy / sxx) * sxx) AS chi2, greatest(0, yy - 2 * (sxy / sxx) * xy + (sxy / sxx) * (sxy / sxx) * xx) AS sse FROM (
      SELECT {own}count(*) AS n, sum({w} * {x} * {x}) AS sxx, sum({w} * {x} * {y}) AS sxy, sum({w} * {y} * {y}) AS syy, sum({x} * {x}) AS xx, sum({x} * {y}) AS xy, sum({y} * {y}) AS yy, sum({y}) AS sy FROM {source} {by}))"""


def pooled(keys: str = "") -> str:
    source = "(SELECT *, k2 * diffusion_time AS x, -ln(correlation) AS y FROM decay WHERE diffusion_time BETWEEN 2 AND 20 AND n2 <= 4 AND correlation > 0 AND correlation < 1)"
    own = f"{keys}, " if keys else ""
    return f"SELECT {own}n, a AS d, sqrt(chi2 / (n - 1) / sxx) AS se, (yy - sy * sy / n - sse) / (yy - sy * sy / n) AS r2 FROM {origin(source, 'x', 'y', keys)}"


POOLED = "n, round(d, 6) AS d, round(se, 6) AS d_se, round(r2, 6) AS r2, round(sqrt(6 * d), 6) AS a_rms, round(3 * se / sqrt(6 * d), 6) AS a_rms_se"
ROOT = "(SELECT *, sqrt(diffusion_time) AS x FROM lengths)"
MESH = f"{POINTS}, cells AS (SELECT a::INT AS ix, b::INT AS iy, c::INT AS iz FROM range({M}) x(a), range({M}) y(b), range({M}) z(c)), hits AS (SELECT floor(x / 12.5)::INT AS ix, floor(y / 12.5)::INT AS iy, floor(z / 12.5)::INT AS iz, count(*) AS n FROM points GROUP BY 1, 2, 3), field AS (SELECT ix, iy, iz, coalesce(n, 0) / ((SELECT count(*) FROM points) / {M**3}::DOUBLE) - 1 AS v FROM cells LEFT JOIN hits USING (ix, iy, iz))"


def dft() -> str:
    parts, source, re_im = [], "field", "v AS re, 0.0::DOUBLE AS im"
    for axis in ("ix", "iy", "iz"):
        rest = ", ".join(a for a in ("ix", "iy", "iz") if a != axis)
        parts.append(f"f{axis} AS (SELECT k AS {axis}, {rest}, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM (SELECT ix, iy, iz, {re_im} FROM {source}) JOIN phase ON i = {axis} GROUP BY k, {rest})")
        source, re_im = f"f{axis}", "re, im"
    return f"{MESH}, phase AS (SELECT k::INT AS k, i::INT AS i, cos(-2 * pi() / {M} * k * i) AS c, sin(-2 * pi() / {M} * k * i) AS s FROM range({M}) a(k), range({M}) b(i)), {', '.join(parts)}"


def sign(index: str) -> str:
    return f"(CASE WHEN {index} <= {M // 2} THEN {index} ELSE {index} - {M} END)"


def sinc(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE sin(pi() * {n} / {M}.0) / (pi() * {n} / {M}.0) END)"


SHELLS = f"{dft()}, modes AS (SELECT {sign('ix')} AS nx, {sign('iy')} AS ny, {sign('iz')} AS nz, re, im FROM fiz), shell AS (SELECT nx * nx + ny * ny + nz * nz AS n2, avg((re * re + im * im) * {VOLUME / M**6!r}::DOUBLE / pow({sinc('nx')} * {sinc('ny')} * {sinc('nz')}, 2)) AS p_raw, count(*) AS n_modes FROM modes WHERE nx <> 0 OR ny <> 0 OR nz <> 0 GROUP BY 1), spec AS (SELECT n2, {TAU!r}::DOUBLE * sqrt(n2) AS k, p_raw, 1e6::DOUBLE / (SELECT count(*) FROM points) AS p_shot, n_modes FROM shell)"
MODE_N2 = f"SELECT DISTINCT {sign('a')} * {sign('a')} + {sign('b')} * {sign('b')} + {sign('c')} * {sign('c')} AS n2 FROM range({M}) x(a), range({M}) y(b), range({M}) z(c)"


LINEAR = f"{CURVE}, lin AS (SELECT 0.05::DOUBLE * pow(1.09::DOUBLE, t) AS k, 1e4 * p AS p FROM curve), piece AS (SELECT k AS k0, p AS p0, lead(k) OVER (ORDER BY k) AS k1, lead(p) OVER (ORDER BY k) AS p1 FROM lin)"


def mode_power(inside: str) -> str:
    return f"WITH {LINEAR}, m AS (SELECT n2::INT AS n2, {TAU!r}::DOUBLE * sqrt(n2) AS k FROM ({MODE_N2}) WHERE n2 > 0) SELECT n2, round(coalesce(CASE WHEN k = (SELECT max(k) FROM lin) THEN (SELECT max_by(p, k) FROM lin) ELSE {inside} END, 0), 6) AS p FROM m LEFT JOIN piece ON k >= k0 AND k < k1"


def catalogue_sql(name: str) -> str:
    """Shell spectrum of a catalogue by three sums; needs points, cells and phase."""
    parts = [f"{name}_p AS (SELECT * FROM points WHERE {CATALOGUES[name]}), {name}_h AS (SELECT floor(x / 12.5)::INT AS ix, floor(y / 12.5)::INT AS iy, floor(z / 12.5)::INT AS iz, count(*) AS n FROM {name}_p GROUP BY 1, 2, 3), {name}_f AS (SELECT ix, iy, iz, coalesce(n, 0) / ((SELECT count(*) FROM {name}_p) / {M**3}::DOUBLE) - 1 AS v FROM cells LEFT JOIN {name}_h USING (ix, iy, iz))"]
    source, re_im = f"{name}_f", "v AS re, 0.0::DOUBLE AS im"
    for axis in ("ix", "iy", "iz"):
        rest = ", ".join(a for a in ("ix", "iy", "iz") if a != axis)
        parts.append(f"{name}_{axis} AS (SELECT k AS {axis}, {rest}, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM (SELECT ix, iy, iz, {re_im} FROM {source}) JOIN phase ON i = {axis} GROUP BY k, {rest})")
        source, re_im = f"{name}_{axis}", "re, im"
    parts.append(f"{name} AS (SELECT n2, {TAU!r}::DOUBLE * sqrt(n2) AS k, p, n_modes FROM (SELECT nx * nx + ny * ny + nz * nz AS n2, avg((re * re + im * im) * {VOLUME / M**6!r}::DOUBLE / pow({sinc('nx')} * {sinc('ny')} * {sinc('nz')}, 2)) AS p, count(*) AS n_modes FROM (SELECT {sign('ix')} AS nx, {sign('iy')} AS ny, {sign('iz')} AS nz, re, im FROM {name}_iz) WHERE nx <> 0 OR ny <> 0 OR nz <> 0 GROUP BY 1))")
    return ", ".join(parts)


def catalogues_sql(*names: str) -> str:
    head = f"{POINTS}, cells AS (SELECT a::INT AS ix, b::INT AS iy, c::INT AS iz FROM range({M}) x(a), range({M}) y(b), range({M}) z(c)), phase AS (SELECT k::INT AS k, i::INT AS i, cos(-2 * pi() / {M} * k * i) AS c, sin(-2 * pi() / {M} * k * i) AS s FROM range({M}) a(k), range({M}) b(i))"
    return ", ".join([head, *map(catalogue_sql, names)])


KERNEL = f"{catalogues_sql('every')}, grid AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS radius), variance AS (SELECT radius, sum(n_modes * p * exp(-pow(k * radius, 2) / 6)) / 1e6 AS sigma2 FROM every, grid GROUP BY 1)"
LOGLOG = "exp(ln(p0) + (ln(k) - ln(k0)) * (ln(p1) - ln(p0)) / (ln(k1) - ln(k0)))"
BIAS = f"{catalogues_sql('every')}, {LINEAR}, biased AS (SELECT s.*, {LOGLOG} AS p_lin FROM every s JOIN piece ON k >= k0 AND k < k1)"
CORNERS = " UNION ALL ".join(f"SELECT id, ({'fx' if o & 1 else '(1 - fx)'}) * ({'fy' if o & 2 else '(1 - fy)'}) * ({'fz' if o & 4 else '(1 - fz)'}) AS w, (jx + {o & 1}) % {M} AS ix, (jy + {o >> 1 & 1}) % {M} AS iy, (jz + {o >> 2 & 1}) % {M} AS iz FROM spots" for o in range(8))
TAILS = """c AS (SELECT *, max(median) OVER (PARTITION BY diffusion_time ORDER BY r) AS curve, count(*) OVER (PARTITION BY diffusion_time) AS n, row_number() OVER (PARTITION BY diffusion_time ORDER BY r DESC) AS back FROM bins WHERE pair_count >= 20),
  tail AS (SELECT diffusion_time, quantile_cont(curve, 0.5) AS plateau, min(r) AS tail_start, count(*) AS tail_bins, (max(curve) - min(curve)) / quantile_cont(curve, 0.5) AS tail_rise FROM c WHERE back <= greatest(1, ceil(n * 0.2)) GROUP BY 1),
  step AS (SELECT c.diffusion_time, r, curve, plateau, tail_start, tail_rise, lag(r) OVER (PARTITION BY c.diffusion_time ORDER BY r) AS pr, lag(curve) OVER (PARTITION BY c.diffusion_time ORDER BY r) AS pc FROM c JOIN tail USING (diffusion_time))"""


def reach(f: float) -> str:
    name = f"ell_{f:g}".replace(".", "_")
    x = f"CASE WHEN pr IS NULL OR curve = pc THEN r ELSE pr + (r - pr) * ({f} * plateau - pc) / (curve - pc) END"
    return f"(SELECT round(CASE WHEN min_by({x}, r) < any_value(s.tail_start) AND any_value(s.tail_rise) <= 0.15 THEN min_by({x}, r) END, 6) FROM step s WHERE s.diffusion_time = tail.diffusion_time AND curve >= {f} * plateau) AS {name}"


BINNED = "binned AS (SELECT floor((distance - 20) / 5)::INT AS bin, count(*) AS pair_count, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.16) AS q16, quantile_cont(y, 0.84) AS q84 FROM measured WHERE distance >= 20 AND distance < 70 GROUP BY 1)"
WEIGHTED = "count(*) AS n, sum(w) AS sw, sum(w * w) AS sww, sum(w * distance) AS swx, sum(w * y) AS swy, sum(w * y * y) AS swyy"
ORACLE_SQL = {
    "i4_shell_length": f"WITH {DECAY}, u AS (SELECT *, -ln(correlation) AS y, correlation * correlation / (sigma * sigma) AS w FROM decay WHERE correlation > 0.05 AND correlation < 1) SELECT diffusion_time, n, round(sqrt(6 * a), 6) AS ell, round(6 * a, 6) AS mean_square, round(sqrt(sse / n) / sqrt(yy / n), 6) AS relative_rmse FROM {origin('u', 'k2', 'y', 'diffusion_time', 'w')} WHERE n >= 2",
    "i5_pooled_diffusivity": f"WITH {DECAY} SELECT {POOLED} FROM ({pooled()})",
    "i6_mode_diffusivity": f"WITH {DECAY} SELECT n2, {POOLED} FROM ({pooled('n2')})",
    "i7_radius": f"WITH {CURVE} SELECT t, round(10.4 * sqrt(t), 6) AS radius, round(0.02 * sqrt(t), 6) AS error FROM curve",
    "i9_lengths_at": f"WITH {LENGTHS}, s AS (SELECT diffusion_time::DOUBLE AS t0, length AS l0, coalesce(lead(diffusion_time) OVER (ORDER BY diffusion_time), diffusion_time)::DOUBLE AS t1, coalesce(lead(length) OVER (ORDER BY diffusion_time), length) AS l1 FROM lengths), q AS (SELECT i / 2.0::DOUBLE AS t FROM range(70) r(i)) SELECT t, round(CASE WHEN t0 = t1 THEN l0 ELSE exp(ln(l0) + (ln(t) - ln(t0)) * (ln(l1) - ln(l0)) / (ln(t1) - ln(t0))) END, 6) AS length FROM q LEFT JOIN s ON t >= t0 AND (t < t1 OR t0 = t1 AND t = t0)",
    "i10_merge_lengths": f"WITH {LENGTHS} SELECT diffusion_time, round(length + (diffusion_time >= 15)::INT, 6) AS length FROM lengths",
    "i11_with_lengths": f"WITH {SPECTRAL}, {LENGTHS}, j AS (SELECT t AS diffusion_time, ds, length, coalesce(abs(ds - 3) <= 0.1, false) AS in_band FROM spectral JOIN lengths ON diffusion_time = t) SELECT diffusion_time, round(ds, 6) AS ds, round(length, 6) AS length, in_band, in_band AND length = coalesce((SELECT min(length) FROM j WHERE in_band), -1) AS first_in_band FROM j",
    "i12_containment": f"WITH {BINS}, {TAILS} SELECT diffusion_time, round(plateau, 6) AS plateau, tail_start, tail_bins, round(tail_rise, 6) AS tail_rise, tail_rise <= 0.15 AS accepted, {reach(0.4)}, {reach(0.5)}, {reach(0.6)} FROM tail",
    "i13_origin_fit": f"WITH {LENGTHS} SELECT n, round(a, 6) AS slope, round(sqrt(chi2 / (n - 1) / sxx), 6) AS slope_se, round((yy - sy * sy / n - sse) / (yy - sy * sy / n), 6) AS r2, round(sqrt(sse / n), 6) AS rmse, round(sqrt(sse / yy), 6) AS relative_rmse FROM {origin(ROOT, 'x', 'length')}",
    "i14_prefactor": f"WITH {LENGTHS}, f AS (SELECT a FROM {origin(ROOT, 'x', 'length')}), r AS (SELECT length / (a * sqrt(diffusion_time)) - 1 AS r, a FROM lengths, f) SELECT round(max(a), 6) AS a, round(sqrt(avg(r * r)), 6) AS rms, round(max(abs(r)), 6) AS largest FROM r",
    "i16_merged_harmonics": f"WITH {DECAY} SELECT {POOLED} FROM ({pooled()})",
    "i17_adopted": f"WITH {DECAY}, p AS (SELECT sqrt(6 * d) AS a FROM ({pooled('n2')})) SELECT round(quantile_cont(a, 0.5), 6) AS a FROM p",
    "i18_sensitivity": f"WITH {DECAY}, p AS (SELECT sqrt(6 * d) AS a, r2 FROM ({pooled('n2')})) SELECT round(max(a) - min(a), 6) AS spread, round((max(a) - min(a)) / avg(a), 6) AS relative_spread, round(min(r2), 6) AS r2_min, round(max(r2), 6) AS r2_max FROM p",
    "j2_binned_curve": f"WITH {MEASURED}, {BINNED} SELECT bin, round(20 + (bin + 0.5) * 5, 6)::DOUBLE AS center, pair_count, round(median, 6) AS median, round(q16, 6) AS q16, round(q84, 6) AS q84 FROM binned",
    "j3_linearity": f"WITH {MEASURED}, {BINNED}, u AS (SELECT (20 + (bin + 0.5) * 5)::DOUBLE AS center, median FROM binned WHERE pair_count >= 5) SELECT n AS n_bins, round(a, 6) AS linear_scale, round(sqrt(sse / n) / (sy / n), 6) AS relative_rmse, round((SELECT pow(corr(center, median), 2) FROM u), 6) AS linear_r2 FROM {origin('u', 'center', 'median')}",
    "j4_weighted_bins": f"WITH {MEASURED}, g AS (SELECT floor((distance - 20) / 10)::INT AS bin, {WEIGHTED} FROM measured WHERE distance >= 20 AND distance < 70 GROUP BY 1) SELECT bin, n, round(swx / sw, 6) AS x_mean, round(swy / sw, 6) AS y_mean, round(sqrt(greatest(0, swyy / sw - pow(swy / sw, 2))), 6) AS y_std, round(sqrt(greatest(0, swyy / sw - pow(swy / sw, 2))) * sqrt(sww) / sw, 6) AS y_se, round((swy - swx) / sw, 6) AS residual FROM g",
    "j4_log_bins": f"WITH {MEASURED} SELECT least(5, floor(6 * ln(distance / 10) / ln(8.0::DOUBLE)))::INT AS bin, count(*) AS n, round(sum(w * y) / sum(w), 6) AS y_mean FROM measured WHERE distance >= 10 AND distance < 80 GROUP BY 1",
    "j5_identity": f"WITH {MEASURED}, e AS (SELECT distance AS x, y * 50 AS y FROM measured) SELECT count(*) AS n, round(sqrt(avg(pow(y - x, 2))), 6) AS rmse, round(sqrt(avg(pow(y - x, 2) / (x * x))), 6) AS fractional_rmse, round(1 - sum(pow(y - x, 2)) / regr_syy(y, x), 6) AS r2_identity, round(sum(x * y) / sum(x * x), 6) AS slope FROM e",
    "k5_density_curve": f"WITH {DENSITY} SELECT round(radius, 6) AS radius, round(mean, 6) AS mean, round({EXPECTED}, 6) AS expected, round(mean / {EXPECTED}, 6) AS scaled, round(d2, 6) AS d2 FROM dense",
    "k6_joint_criterion": f"WITH {DENSITY}, m AS (SELECT radius, CASE WHEN d2 IS NOT NULL THEN least(0.1 - abs(mean / {EXPECTED} - 1), 0.3 - abs(d2 - 3)) END AS margin FROM dense) SELECT round(radius, 6) AS radius, round(margin, 6) AS margin, {persistent('margin >= 0', 'radius', [])} AS starts_run FROM m",
    "l1_mesh_counts": f"WITH {MESH} SELECT ix, iy, iz, n FROM hits",
    "l2_contrast": f"WITH {MESH} SELECT ix, iy, iz, round(v, 6) AS v FROM field",
    "l3_transform": f"WITH {dft()} SELECT ix, iy, iz, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM fiz",
    "l3_transform_by_sums": f"WITH {dft()} SELECT ix, iy, iz, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM fiz",
    "l5_shell_spectrum": f"WITH {SHELLS} SELECT n2, round(k, 6) AS k, round(p_raw, 6) AS p_raw, round(p_shot, 6) AS p_shot, round(p_raw - p_shot, 6) AS p_sub, n_modes FROM spec",
    "l5_shell_geometry": f"WITH {SHELLS}, g AS (SELECT a * a + b * b + c * c AS n2, count(*) AS n_modes FROM range(-3, 4) x(a), range(-3, 4) y(b), range(-3, 4) z(c) WHERE a * a + b * b + c * c BETWEEN 1 AND 9 GROUP BY 1) SELECT g.n2, g.n_modes, spec.n_modes AS measured FROM g LEFT JOIN spec USING (n2)",
    "l7_linear_bins": f"WITH {SHELLS} SELECT floor(k / 0.1)::BIGINT AS bin, sum(n_modes)::BIGINT AS n_modes, round(sum(k * n_modes) / sum(n_modes), 6) AS k_mean, round(sum((p_raw - p_shot) * n_modes) / sum(n_modes), 6) AS p_mean FROM spec GROUP BY 1",
    "l8_compare_shells": f"WITH {SHELLS} SELECT n2, round(k, 6) AS k, n_modes, round(p_raw / (1000.0 / n2), 6) AS ratio FROM spec WHERE n2 <= 16 AND n2 IN (SELECT a * a + b * b + c * c FROM range(5) x(a), range(5) y(b), range(5) z(c))",
    "m1_filtered_variance": f"WITH {KERNEL} SELECT radius, round(sigma2, 6) AS sigma2 FROM variance",
    "m2_log_derivatives": f"WITH {KERNEL}, l AS (SELECT radius, ln(radius) AS lx, sigma2 AS a, ln(sigma2) AS b FROM variance), g AS (SELECT *, lag(lx) OVER w AS x0, lag(a) OVER w AS a0, lag(b) OVER w AS b0, lead(lx) OVER w AS x1, lead(a) OVER w AS a1, lead(b) OVER w AS b1 FROM l WINDOW w AS (ORDER BY lx)) SELECT radius, "
    + ", ".join(f"round(-(CASE WHEN x0 IS NULL THEN ({c}1 - {c}) / (x1 - lx) WHEN x1 IS NULL THEN ({c} - {c}0) / (lx - x0) ELSE (pow(lx - x0, 2) * {c}1 - pow(x1 - lx, 2) * {c}0 + (pow(x1 - lx, 2) - pow(lx - x0, 2)) * {c}) / ((lx - x0) * (x1 - lx) * (x1 - x0)) END), 6) AS {n}" for c, n in (("a", "x"), ("b", "gamma")))
    + " FROM g",
    "m3_interpolate": f"WITH {KERNEL}, s AS (SELECT radius AS x0, sigma2 AS y0, lead(radius) OVER w AS x1, lead(sigma2) OVER w AS y1 FROM variance WINDOW w AS (ORDER BY radius)), q AS (SELECT i * 4.5::DOUBLE AS a FROM range(1, 15) r(i)) SELECT a AS \"at\", round(CASE WHEN a < 10 THEN (SELECT max(sigma2) FROM variance) WHEN a >= 55 THEN (SELECT min(sigma2) FROM variance) ELSE y0 + (a - x0) * (y1 - y0) / (x1 - x0) END, 6) AS value FROM q LEFT JOIN s ON a >= x0 AND a < x1",
    "m3_long_curve": """WITH knots AS (SELECT p_retailprice::DOUBLE + p_partkey / 1000000 AS x, max(p_size + p_partkey % 10 / 10) AS y FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1),
      s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM knots),
      q AS (SELECT o_orderkey, o_totalprice / 100 AS a FROM orders)
      SELECT o_orderkey, a AS "at", round(CASE WHEN x0 IS NULL THEN (SELECT min_by(y, x) FROM knots) WHEN x1 IS NULL THEN y0 ELSE y0 + (a - x0) * (y1 - y0) / (x1 - x0) END, 6) AS value
      FROM q ASOF LEFT JOIN s ON a >= x0""",
    "m4_contributions": f"WITH {catalogues_sql('every')}, c AS (SELECT *, n_modes * p * exp(-pow(k * 20, 2) / 6) AS c FROM every) SELECT n2, round(k, 6) AS k, n_modes, round(c, 6) AS contribution, round(c / (SELECT sum(c) FROM c), 6) AS share FROM c ORDER BY c DESC, n2 LIMIT 20",
    "m6_weighted_fit": f"WITH {SPECTRAL}, u AS (SELECT 1 / t::DOUBLE AS x, ds - 3 AS y, t::DOUBLE AS w FROM spectral WHERE ds IS NOT NULL) SELECT n, round(a, 6) AS slope, round(sqrt(chi2 / (n - 1) / sxx), 6) AS slope_se, round(1 / sqrt(sxx), 6) AS slope_formal_se, round((yy - sy * sy / n - sse) / (yy - sy * sy / n), 6) AS r2, round(sqrt(sse / n), 6) AS rmse, round(sqrt(sse / yy), 6) AS relative_rmse, round(chi2, 6) AS chi2, round(chi2 / (n - 1), 6) AS reduced_chi2 FROM {origin('u', 'x', 'y', '', 'w')}",
    "m8_filtered_ratio": f"WITH {KERNEL}, {catalogue_sql('even')}, second AS (SELECT radius, sum(n_modes * p * exp(-pow(k * radius, 2) / 6)) / 1e6 AS s FROM even, grid GROUP BY 1) SELECT radius, round(sigma2, 6) AS sigma2_first, round(s, 6) AS sigma2_second, round(sigma2 / s, 6) AS ratio FROM variance JOIN second USING (radius)",
    "m9_three_way": f"WITH {catalogues_sql('every', 'even', 'third')} SELECT a.n2, round(a.k, 6) AS k, a.n_modes, round(a.p, 6) AS p, round(b.p, 6) AS p_b, round(c.p, 6) AS p_c, round(a.p / b.p, 6) AS ratio_b, round(a.p / c.p, 6) AS ratio_c FROM every a JOIN even b USING (n2) JOIN third c USING (n2)",
    "m10_band_summary": f"WITH {catalogues_sql('every', 'even')}, r AS (SELECT a.k, a.n_modes, a.p / b.p AS ratio FROM every a JOIN even b USING (n2)), bands AS (SELECT * FROM (VALUES {', '.join(map(str, BANDS))}) v(band, k_lo, k_hi)) SELECT band, count(*) AS n, round(quantile_cont(ratio, 0.5), 6) AS median, round(quantile_cont(ratio, 0.16), 6) AS q16, round(quantile_cont(ratio, 0.84), 6) AS q84, round(exp(avg(ln(ratio))), 6) AS log_mean, round(sum(ratio * n_modes) / sum(n_modes), 6) AS weighted FROM r JOIN bands ON k >= k_lo AND k < k_hi GROUP BY band",
    "m12_bias": f"WITH {BIAS} SELECT n2, round(p_lin, 6) AS p_lin, round(sqrt(p / p_lin), 6) AS bias FROM biased",
    "m12_effective_bias": f"WITH {BIAS} SELECT round(sqrt(sum(n_modes * p) / sum(n_modes * p_lin)), 6) AS mode_bias, round(sqrt(sum(n_modes * exp(-pow(k * 20, 2) / 6) * p) / sum(n_modes * exp(-pow(k * 20, 2) / 6) * p_lin)), 6) AS kernel_bias, round(sum(n_modes * sqrt(p / p_lin)) / sum(n_modes), 6) AS mean_bias FROM biased",
    "n2_mode_powers_linear": mode_power("p0 + (k - k0) * (p1 - p0) / (k1 - k0)"),
    "n3_mode_powers": mode_power(LOGLOG),
    "n5_mesh_at_points": f"WITH {MESH}, spots AS (SELECT id, floor(x / 12.5)::INT AS jx, floor(y / 12.5)::INT AS jy, floor(z / 12.5)::INT AS jz, x / 12.5 - floor(x / 12.5) AS fx, y / 12.5 - floor(y / 12.5) AS fy, z / 12.5 - floor(z / 12.5) AS fz FROM points), corner AS ({CORNERS}) SELECT id, round(sum(w * v), 6) AS value FROM corner JOIN field USING (ix, iy, iz) GROUP BY id",
    "n7_weights": f"WITH {MESH} SELECT ix, iy, iz, round(1000 * exp(1.5 * v) / (SELECT sum(exp(1.5 * v)) FROM field), 6) AS p FROM field",
    "n9_float_wrap": f"WITH {POINTS} SELECT id, CASE WHEN (100 - x * 1e-7)::FLOAT >= 100 THEN 0::FLOAT ELSE (100 - x * 1e-7)::FLOAT END AS x FROM points",
    "n8_field_statistics": f"WITH {MESH} SELECT round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most, round(sqrt(avg(v * v)), 6) AS rms FROM field",
    "n8_effective_cells": f"WITH {MESH}, w AS (SELECT exp(v) / (SELECT sum(exp(v)) FROM field) AS p FROM field) SELECT round(1 / sum(p * p), 6) AS n_effective FROM w",
}
BOOT_COUNTS = f"""{COUNTS}, draws AS (SELECT b, ((b * 1103 + i * 7919 + b * i * 31 + b * b * 17) % 10007) % (SELECT count(*) FROM points) AS unit, count(*) AS c FROM range({REPLICATES}) r(b), range((SELECT count(*) FROM points)) s(i) GROUP BY 1, 2),
  means AS (SELECT b, radius, sum(c * count) / sum(c)::DOUBLE AS mean FROM counts JOIN draws ON unit = center GROUP BY 1, 2), {shifted("means", ["b"], "dense")},
  m AS (SELECT b, radius, CASE WHEN d2 IS NOT NULL THEN least(0.2 - abs(mean / {EXPECTED} - 1), 0.4 - abs(d2 - 3)) END AS margin FROM dense),
  runs AS (SELECT *, {persistent("margin >= 0", "radius", ["b"], 2)} AS run, lag(margin) OVER (PARTITION BY b ORDER BY radius) AS pm, lag(radius) OVER (PARTITION BY b ORDER BY radius) AS pr FROM m)"""
ORACLE_SQL["k7_bootstrap_scales"] = f"WITH {BOOT_COUNTS} SELECT b, round(min(radius) FILTER (run), 6) AS discrete, round(min_by(CASE WHEN pm < 0 THEN exp(ln(pr) + (ln(radius) - ln(pr)) * (0 - pm) / (margin - pm)) ELSE radius END, radius) FILTER (run), 6) AS interpolated FROM runs GROUP BY b"
