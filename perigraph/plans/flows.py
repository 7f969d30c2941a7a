"""The three analyses that the operators make up: catalogue to graph, trace to transport scale, points to ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bootstrap, compare, crossing, density, fits, graph, length, selection, spatial


def catalogue_to_graph(catalogue: DataFrame, rank_by: str, number_density: float, box: float, k: int = 12, row_order: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """The points of largest rank at a number density, and their symmetric neighbour graph."""
    chosen = selection.exact_top(catalogue, rank_by, selection.target_count(number_density, box), list(row_order))
    points = chosen.select("id", *[F.col(c).cast("float").alias(c) for c in "xyz"])
    return points, graph.neighbour_graph(spatial.nearest_neighbours(points, k, box))


def bootstrap_curves(trace: DataFrame, replicates: int, n_probes: int, width: int = 7, seed: int = 12345) -> DataFrame:
    """b, t, ds: spectral dimension of each resampled mean trace; every time keeps a replicate's probes."""
    counts = bootstrap.multiplicities(bootstrap.draws(trace.sparkSession, replicates, n_probes, seed))
    means = bootstrap.resampled_means(trace.withColumnRenamed("diffusion_time", "t"), counts, "probe_index", "t", "individual_trace_estimate")
    return fits.centred_dimension(means, ["b"], "t", "mean", width).select("b", "t", "ds", "r2")


def central_r2(trace: DataFrame, width: int = 7) -> DataFrame:
    mean = trace.groupBy(F.col("diffusion_time").alias("t")).agg(F.avg("individual_trace_estimate").alias("p"))
    return fits.centred_dimension(mean, [], "t", "p", width).select("t", F.col("r2").alias("r2_central"))


def transport_scale(trace: DataFrame, replicates: int, n_probes: int, a: float, a_se: float = 0.0, width: int = 7, tolerance: float = 0.03, persistence: int = 3, min_r2: float = 0.98, gate: str = "central", seed: int = 12345) -> DataFrame:
    """b, crossing (time), radius: where each replicate's dimension stays within tolerance of 3, and its length A sqrt(t).

    gate says whose fits must be good: the central curve's or each replicate's own. The calibration's error, if given,
    comes as the column radius_se.
    """
    curves = bootstrap_curves(trace, replicates, n_probes, width, seed)
    ok = f"r2 >= {min_r2}"
    if gate == "central":
        curves, ok = curves.join(central_r2(trace, width), "t"), f"r2_central >= {min_r2}"
    found = crossing.interpolated_crossing(curves, ["b"], "t", crossing.spectral_margin("ds", 3.0, tolerance), ok, persistence)
    return found.select("b", "crossing", length.radius_of(F.col("crossing"), F.lit(a)).alias("radius"), length.calibration_error(F.col("crossing"), F.lit(a_se)).alias("radius_se"))


def truncation_sweep(trace: DataFrame, replicates: int, n_probes: int, limits: list[int], width: int = 7, tolerance: float = 0.03, persistence: int = 3, seed: int = 12345) -> DataFrame:
    """Success fraction and quantiles of the crossing for each largest time, windows refitted within it."""
    spark = trace.sparkSession
    bounds = spark.createDataFrame([(t,) for t in limits], "t_max int")
    counts = bootstrap.multiplicities(bootstrap.draws(spark, replicates, n_probes, seed))
    means = bootstrap.resampled_means(trace.withColumnRenamed("diffusion_time", "t"), counts, "probe_index", "t", "individual_trace_estimate")
    cut = means.join(F.broadcast(bounds), F.col("t") <= F.col("t_max"))
    curves = fits.centred_dimension(cut, ["t_max", "b"], "t", "mean", width)
    found = crossing.interpolated_crossing(curves, ["t_max", "b"], "t", crossing.spectral_margin("ds", 3.0, tolerance), persistence=persistence)
    return bootstrap.bands(found, ["t_max"], "crossing")


def density_transport_ratio(counts: DataFrame, n_density: float, transport: DataFrame, replicates: int, n_centres: int, width: int = 5, seed: int = 12345) -> DataFrame:
    """Quantiles of the ratio of transport (radius) to density scales over all pairs of replicates.

    Centres are numbered from 0 in counts (center).
    """
    drawn = bootstrap.multiplicities(bootstrap.draws(counts.sparkSession, replicates, n_centres, seed))
    scales = density.bootstrap_scales(counts, drawn, n_density, width)
    return compare.all_pairs_ratio(transport.select(F.col("radius").alias("value")).dropna(), scales.select(F.col("interpolated").alias("value")).dropna())


def numbered_centres(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n sampled points with id 0..n-1, for resampling; n is small."""
    chosen = selection.uniform_sample(points, n, ["id"], seed)
    return chosen.withColumn("id", F.row_number().over(Window.orderBy("id")) - 1)
