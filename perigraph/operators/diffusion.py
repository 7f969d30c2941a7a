"""Random-walk propagation on a graph and the stochastic return trace.

A state is a table of nodes with one column per probe. A step joins the edges with the state by node and sums. Edges and
states are kept as tables bucketed by node, so the edges, by far the larger side, never move: a step shuffles only its
partial sums. Lineage is cut by these tables; states saved as checkpoints let a later run resume.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_normal
from ..session import drop_table, materialize_by, require
from .blocks import return_trace_by_blocks


def gaussian_probes(nodes: DataFrame, n_probes: int, seed: int = 0) -> DataFrame:
    """id and y0, y1, ... with entries N(0, 1) / sqrt(n_probes), drawn by node and probe."""
    return nodes.select("id", *[(hash_normal(F.lit(seed), F.col("id"), F.lit(i)) / float(n_probes) ** 0.5).alias(f"y{i}") for i in range(n_probes)])


def one_hot(nodes: DataFrame, source: int) -> DataFrame:
    """A state that is 1 at one node."""
    return nodes.select("id", F.when(F.col("id") == source, 1.0).otherwise(0.0).alias("y0"))


def transition(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """src, dst, p: edge weights over the degree of src."""
    joined = edges.join(degree.withColumnRenamed("id", "src"), "src")
    return joined.select("src", "dst", (F.col("w").cast("double") / F.col("degree")).alias("p"))


def step(walk: DataFrame, state: DataFrame) -> DataFrame:
    """One application of the row-stochastic matrix; a node without edges gets 0."""
    columns = [c for c in state.columns if c != "id"]
    sums = walk.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("p") * F.col(c)).alias(c) for c in columns])
    return state.select("id").join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def propagate(walk: DataFrame, state: DataFrame, times: list[int], start: int = 0, cut_every: int = 4):
    """Yields (time, state) at each requested time above start, in order. Of the tables it writes, those between requested
    times are removed once the next is there."""
    done, between = start, None
    for time in sorted(t for t in set(times) if t > start):
        while done < time:
            state = step(walk, state)
            done += 1
            if done % cut_every == 0 or done == time:
                state = materialize_by(state, f"state-{done}", "id")
                if between is not None:
                    drop_table(between)
                between = state if done < time else None
        yield time, state


def trace_estimates(initial: DataFrame, state: DataFrame, time: int) -> DataFrame:
    """diffusion_time, probe_index, individual_trace_estimate: n_probes * sum of initial times propagated entries."""
    columns = [c for c in initial.columns if c != "id"]
    later = state.select("id", *[F.col(c).alias(f"t_{c}") for c in columns])
    sums = initial.join(later, "id").agg(*[(len(columns) * F.sum(F.col(c) * F.col(f"t_{c}"))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(i).alias("probe_index"), F.col(c).alias("individual_trace_estimate")) for i, c in enumerate(columns)])
    return sums.select(F.lit(time).alias("diffusion_time"), F.explode(pairs).alias("e")).select("diffusion_time", "e.*")


def trace_summary(trace: DataFrame, n_nodes: int) -> DataFrame:
    """Per time: mean and standard error (NULL for one probe) of the trace, the same per node, relative error."""
    out = trace.groupBy("diffusion_time").agg(F.count(F.lit(1)).alias("n_probes"), F.avg("individual_trace_estimate").alias("trace"), F.stddev_samp("individual_trace_estimate").alias("sd"))
    se = F.col("sd") / F.sqrt("n_probes")
    return out.select("diffusion_time", "n_probes", "trace", se.alias("trace_se"), (F.col("trace") / n_nodes).alias("p_return"), (se / n_nodes).alias("p_return_se"), (se / F.col("trace")).alias("relative_se"))


def return_trace(edges: DataFrame, degree: DataFrame, initial: DataFrame, times: list[int], blocks: DataFrame | None = None, depth: int = 4) -> DataFrame:
    """Trace estimates at the requested times, from a state of probes at time 0; with blocks (id, block) of near nodes,
    by rounds of depth steps for one exchange, else step by step."""
    if blocks is not None:
        return return_trace_by_blocks(transition(edges, degree), blocks, initial, times, depth)
    walk = materialize_by(transition(edges, degree), "walk", "dst")
    initial = materialize_by(initial, "state-0", "id")
    parts = [trace_estimates(initial, initial, 0)] if 0 in times else []
    parts += [trace_estimates(initial, state, time) for time, state in propagate(walk, initial, times)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_state(state: DataFrame, folder: str, time: int) -> str:
    """An immutable checkpoint: fails if it is there already."""
    path = f"{folder}/step={time}"
    state.write.mode("error").parquet(path)
    return path


def saved_times(spark: SparkSession, folder: str) -> list[int]:
    """Times with a complete checkpoint in the folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    done = [n for n in names if n.startswith("step=") and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("step=")) for n in done)


def resume_point(checkpoints: DataFrame, requested: DataFrame, completed: DataFrame) -> DataFrame:
    """One row, resume: the latest checkpoint (time) not above the earliest requested time that is not completed."""
    first = requested.join(completed, "time", "left_anti").agg(F.min("time").alias("first_missing"))
    return checkpoints.crossJoin(F.broadcast(first)).filter("time <= first_missing").agg(F.max("time").alias("resume"), F.max("first_missing").alias("first_missing"))


def resume_trace(edges: DataFrame, degree: DataFrame, folder: str, times: list[int], completed: list[int] = ()) -> DataFrame | None:
    """Trace estimates at requested times that are not completed, from the checkpoints in the folder.

    Times that have a checkpoint are evaluated from it; the rest continue from the latest one below the first of them.
    New states are checkpointed. None if nothing is missing.
    """
    spark = edges.sparkSession
    missing = sorted(set(times) - set(completed))
    saved = saved_times(spark, folder)
    require(0 in saved, "the initial state has no checkpoint")
    initial = spark.read.parquet(f"{folder}/step=0")
    parts = [trace_estimates(initial, spark.read.parquet(f"{folder}/step={t}"), t) for t in missing if t in saved]
    rest = [t for t in missing if t not in saved]
    if rest:
        start = max(t for t in saved if t <= rest[0])
        walk = materialize_by(transition(edges, degree), "walk", "dst")
        for time, state in propagate(walk, spark.read.parquet(f"{folder}/step={start}"), rest, start):
            save_state(state, folder, time)
            parts.append(trace_estimates(initial, state, time))
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fourier_modes(points: DataFrame, vectors: list[tuple[int, int, int]], box: float) -> DataFrame:
    """id and, for each integer wave vector, the columns c<i> = cos(k x) and s<i> = sin(k x)."""
    out = {}
    for i, v in enumerate(vectors):
        phase = F.lit(0.0)
        for n, c in zip(v, "xyz", strict=True):
            phase = phase + F.lit(2 * 3.141592653589793 * n / box) * F.col(c)
        out |= {f"c{i}": F.cos(phase), f"s{i}": F.sin(phase)}
    return points.select("id", *[e.alias(n) for n, e in out.items()])


def harmonic_correlations(edges: DataFrame, degree: DataFrame, points: DataFrame, vectors: list[tuple[int, int, int]], times: list[int], box: float, batch: int = 4) -> DataFrame:
    """Mode correlations of all wave vectors at the times above 0, vectors propagated a batch at a time.

    Propagation is linear, so batches give what all vectors together would, with states of bounded width.
    """
    walk, parts = materialize_by(transition(edges, degree), "walk", "dst"), []
    for at in range(0, len(vectors), batch):
        own = vectors[at : at + batch]
        initial = materialize_by(fourier_modes(points, own, box), "modes", "id")
        parts += [mode_correlations(initial, state, own, time, box) for time, state in propagate(walk, initial, times)]
    return reduce(DataFrame.unionByName, parts)


def mode_correlations(initial: DataFrame, state: DataFrame, vectors: list[tuple[int, int, int]], time: int, box: float, by: str = "norm") -> DataFrame:
    """Per wave vector: correlation of the propagated with the initial mode, over its norm or (by="count") the nodes."""
    names = [c for c in initial.columns if c != "id"]
    later = state.select("id", *[F.col(c).alias(f"t_{c}") for c in names])
    sums = initial.join(later, "id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c) * F.col(f"t_{c}")).alias(f"x_{c}") for c in names], *[F.sum(F.col(c) * F.col(c)).alias(f"n_{c}") for c in names])
    rows = []
    for i, (nx, ny, nz) in enumerate(vectors):
        n2 = nx * nx + ny * ny + nz * nz
        base = F.col(f"n_c{i}") + F.col(f"n_s{i}") if by == "norm" else F.col("n")
        value = (F.col(f"x_c{i}") + F.col(f"x_s{i}")) / base
        rows.append(F.struct(F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), F.lit(nz).alias("nz"), F.lit(n2).alias("n2"), F.lit((2 * 3.141592653589793 / box) ** 2 * n2).alias("k2"), value.alias("correlation")))
    return sums.select(F.lit(time).alias("diffusion_time"), F.explode(F.array(*rows)).alias("e")).select("diffusion_time", "e.*")


def distances_at_checkpoints(pairs: DataFrame, folder: str, times: list[int]) -> DataFrame:
    """Diffusion distances of other pairs, such as more distant ones, at the saved states of these times."""
    spark, saved = pairs.sparkSession, saved_times(pairs.sparkSession, folder)
    lacking = sorted(set(times) - set(saved))
    require(not lacking, f"no checkpoint of the times {lacking}")
    return reduce(DataFrame.unionByName, [diffusion_distances(pairs, spark.read.parquet(f"{folder}/step={t}")).withColumn("diffusion_time", F.lit(t)) for t in times])


def diffusion_distances(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """pairs (id_i, id_j, distance) with the distance of their states, and that over its root mean square."""
    columns = [c for c in state.columns if c != "id"]
    sides = [state.select(F.col("id").alias(f"id_{s}"), F.array(*columns).alias(f"y_{s}")) for s in ("i", "j")]
    d2 = F.expr("aggregate(zip_with(y_i, y_j, (a, b) -> (a - b) * (a - b)), cast(0 as double), (t, v) -> t + v)")
    out = pairs.join(sides[0], "id_i").join(sides[1], "id_j").withColumn("d2", d2)
    scale = out.agg(F.sqrt(F.avg("d2")).alias("rms"))
    return out.crossJoin(F.broadcast(scale)).select(*pairs.columns, F.sqrt("d2").alias("diffusion_distance"), (F.sqrt("d2") / F.col("rms")).alias("normalised"))
