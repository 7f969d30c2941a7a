"""Merging batches of probes and checking their integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import require

KEY = ["probe_index", "diffusion_time"]


def global_index(df: DataFrame, per_batch: int) -> DataFrame:
    """probe_index from batch and local_probe_index."""
    return df.withColumn("probe_index", F.col("batch") * per_batch + F.col("local_probe_index"))


def merge_batches(batches: list[DataFrame], per_batch: int) -> DataFrame:
    """Batches in order, their local probe indices (probe_index) made global; the batch number is kept."""
    out = None
    for i, b in enumerate(batches):
        one = global_index(b.withColumnRenamed("probe_index", "local_probe_index").withColumn("batch", F.lit(i)), per_batch)
        out = one if out is None else out.unionByName(one)
    return out


def merge_by_time(early: DataFrame, late: DataFrame, last_early: int) -> DataFrame:
    """Rows up to a time from one table, later ones from the other."""
    return early.filter(F.col("diffusion_time") <= last_early).unionByName(late.filter(F.col("diffusion_time") > last_early))


def merge_on_common_times(first: DataFrame, second: DataFrame, shift: int) -> DataFrame:
    """Both sets of probes at the times that both have; the second's indices are shifted."""
    times = first.select("diffusion_time").intersect(second.select("diffusion_time"))
    moved = second.withColumn("probe_index", F.col("probe_index") + shift)
    return first.unionByName(moved).join(times, "diffusion_time", "left_semi").select(*first.columns)


def time_summary(trace: DataFrame, value: str = "individual_trace_estimate", n_nodes: float = 1.0) -> DataFrame:
    """Per time: n, mean, sample deviation, standard error, the mean and error per node, relative error."""
    out = trace.groupBy("diffusion_time").agg(F.count(F.lit(1)).alias("n_probes"), F.avg(value).alias("trace_mean"), F.stddev_samp(value).alias("trace_std"))
    se = F.col("trace_std") / F.sqrt(F.col("n_probes").cast("double"))
    return out.select("*", se.alias("trace_se"), (F.col("trace_mean") / n_nodes).alias("p_return"), (se / n_nodes).alias("p_return_se"), (se / F.col("trace_mean")).alias("relative_se"))


def integrity(trace: DataFrame) -> DataFrame:
    """One row: counts of rows, probes, times and cells, index range, repeated cells, least rows per probe and time."""
    cells = trace.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    per_probe = cells.groupBy("probe_index").agg(F.sum("n").alias("n")).agg(F.min("n").alias("min_per_probe"), F.count(F.lit(1)).alias("n_probes"), F.min("probe_index").alias("first_probe"), F.max("probe_index").alias("last_probe"))
    per_time = cells.groupBy("diffusion_time").agg(F.sum("n").alias("n")).agg(F.min("n").alias("min_per_time"), F.count(F.lit(1)).alias("n_times"))
    total = cells.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"), F.sum((F.col("n") > 1).cast("int")).alias("n_repeated"))
    return total.crossJoin(per_probe).crossJoin(per_time)  # one row each


def require_complete(trace: DataFrame, n_probes: int, times: list[int]) -> DataFrame:
    """The trace, if every probe from 0 stands once at every time and nothing else does."""
    r = integrity(trace).first()
    found = {x["diffusion_time"] for x in trace.select("diffusion_time").distinct().collect()}
    good = (r["n_rows"], r["n_cells"], r["n_probes"], r["first_probe"], r["last_probe"]) == (n_probes * len(times), n_probes * len(times), n_probes, 0, n_probes - 1)
    require(good and found == set(times), f"incomplete trace: {r.asDict()}, times {sorted(found ^ set(times))} differ")
    return trace


def with_orders(trace: DataFrame) -> DataFrame:
    """The trace with each row's place (from 0) if ordered by probe, then time, and if by time, then probe.

    A place is that within its probe (or time) and the rows of those before, so only one probe's rows are sorted at once.
    """
    out = trace
    for first, second, name in (("probe_index", "diffusion_time", "by_probe"), ("diffusion_time", "probe_index", "by_time")):
        counts = trace.groupBy(first).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each probe, or time
        own = F.row_number().over(Window.partitionBy(first).orderBy(second)) - 1
        out = out.withColumn(name, own).join(counts.select(first, before.alias("before")), first).withColumn(name, F.col(name) + F.col("before")).drop("before")
    return out.select(*trace.columns, "by_probe", "by_time")


def pivot_trace(trace: DataFrame, times: list[int], value: str = "individual_trace_estimate") -> DataFrame:
    """One row per probe with a column t<time> each; raises where one is missing."""
    wide = trace.groupBy("probe_index").pivot("diffusion_time", times).agg(F.first(value))
    wide = wide.select("probe_index", *[F.col(str(t)).alias(f"t{t}") for t in times])
    require(wide.dropna().count() == wide.count(), "a probe lacks a time")
    return wide


def null_control(trace: DataFrame, anchor: int, exponent: float = -1.5, value: str = "individual_trace_estimate") -> DataFrame:
    """The trace with its mean replaced by a power law through the anchor time; each probe keeps its relative deviation."""
    mean = F.expr(f"avg({value}) over (partition by diffusion_time)")
    at_anchor = trace.filter(F.col("diffusion_time") == anchor).agg(F.avg(value).alias("anchor_mean"))
    target = F.col("anchor_mean") * F.pow(F.col("diffusion_time") / float(anchor), F.lit(exponent))
    return trace.withColumn("_mean", mean).crossJoin(F.broadcast(at_anchor)).withColumn(value, F.col(value) / F.col("_mean") * target).select(*trace.columns)
