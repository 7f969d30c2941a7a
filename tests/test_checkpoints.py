"""Saved states: committed at once, the last few kept, killed runs resumed."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigraph.operators import blocks, checkpoints, diffusion, graph, spatial

from .test_operators import random_points


@pytest.fixture(scope="module")
def setting(spark):
    _, points = random_points(spark, 60)
    edges = graph.neighbour_graph(spatial.nearest_neighbours(points, 3, 10.0)).persist()
    a = np.zeros((60, 60))
    for r in edges.collect():
        a[r["src"], r["dst"]] = r["w"]
    probes = diffusion.gaussian_probes(points, 2, 5).persist()
    y = np.array([[r["y0"], r["y1"]] for r in probes.orderBy("id").collect()])
    p = a / a.sum(1, keepdims=True)
    return points, edges, graph.degrees(edges), probes, lambda times: {(t, i): 2 * float(y[:, i] @ np.linalg.matrix_power(p, t) @ y[:, i]) for t in times for i in (0, 1)}


def values(df):
    return {(r["diffusion_time"], r["probe_index"]): r["individual_trace_estimate"] for r in df.collect()}


def catalog(spark):
    return {r["tableName"] for r in spark.sql("show tables").collect()}


def test_states_are_kept_and_removed(spark, tmp_path, setting):
    probes, folder = setting[3], str(tmp_path / "log")
    log = checkpoints.StateLog(spark, folder, 2)
    for time in (0, 3, 6, 9):
        log.put(time, probes.withColumn("y0", F.col("y0") + time))
    assert log.times() == [0, 6, 9] and len(os.listdir(f"{folder}/states")) == 3
    assert log.read(9).exceptAll(probes.withColumn("y0", F.col("y0") + 9)).isEmpty()
    with pytest.raises(ValueError, match="there already"):
        log.put(9, probes)
    probes.write.parquet(f"{folder}/states/step=12-of-a-killed-run")
    assert checkpoints.StateLog(spark, folder, 2).times() == [0, 6, 9] and log.clean() == 1
    with pytest.raises(ValueError, match="manifest"):
        log.commit(log.manifest()[0], [])
    assert log.times() == [0, 6, 9]


@pytest.mark.parametrize("by_blocks", [False, True])
def test_killed_run_goes_on(spark, tmp_path, setting, monkeypatch, by_blocks):
    """64 steps, killed as the state of 40 is committed: the next run starts at 32, and little is left at the end."""
    points, edges, degree, probes, want = setting
    folder, times, before = str(tmp_path / "run"), [0, 8, 20, 40, 64], catalog(spark)
    cut = blocks.cut_by(points, blocks.morton_code(10.0), 20) if by_blocks else None
    real = checkpoints.StateLog.commit

    def broken(self, number, states):
        if states[-1]["time"] == 40:
            raise RuntimeError("killed")
        real(self, number, states)

    monkeypatch.setattr(checkpoints.StateLog, "commit", broken)
    with pytest.raises(RuntimeError, match="killed"):
        checkpoints.resumable_trace(edges, degree, probes, folder, times, 8, 2, cut, 8)
    monkeypatch.setattr(checkpoints.StateLog, "commit", real)
    for t in catalog(spark) - before:  # a killed driver's own catalog goes with it
        spark.sql(f"drop table {t}")
    assert checkpoints.StateLog(spark, folder).times() == [0, 24, 32]
    starts = []
    for name in ("propagate", "propagate_blocks"):
        monkeypatch.setattr(checkpoints, name, lambda *a, f=getattr(checkpoints, name): (starts.append(a[-1]), f(*a))[1])
    got = values(checkpoints.resumable_trace(edges, degree, probes, folder, times, 8, 2, cut, 8))
    assert got == pytest.approx(want(times)) and starts == [32]
    assert checkpoints.StateLog(spark, folder).times() == [0, 56, 64]
    assert sorted(os.listdir(f"{folder}/states"))[0].startswith("step=0-") and len(os.listdir(f"{folder}/states")) == 3
    assert catalog(spark) == before
    again = values(checkpoints.resumable_trace(edges, degree, probes, folder, [*times, 66], 8, 2, cut, 8))
    assert again == pytest.approx(want([*times, 66]))
