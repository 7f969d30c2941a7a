"""Propagation by blocks with halos against matrices."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigraph.operators import blocks, diffusion, graph, spatial
from perigraph.session import shared_dir

from .test_operators import random_points


@pytest.fixture(scope="module")
def setting(spark):
    _, points = random_points(spark, 150)
    edges = graph.neighbour_graph(spatial.nearest_neighbours(points, 4, 10.0)).persist()
    a = np.zeros((150, 150))
    for r in edges.collect():
        a[r["src"], r["dst"]] = r["w"]
    probes = diffusion.gaussian_probes(points, 3, 5).persist()
    y = np.array([[r["y0"], r["y1"], r["y2"]] for r in probes.orderBy("id").collect()])
    return points, edges, graph.degrees(edges), probes, a / a.sum(1, keepdims=True), y


def leftovers(spark):
    tables = [r["tableName"] for r in spark.sql("show tables").collect() if r["tableName"].startswith("perigraph_")]
    root = shared_dir(spark).removeprefix("file:")
    states = [f for f in os.listdir(root) if f.startswith(("block-state", "shape", "sends"))]
    return set(tables), set(states)


def test_curve_cuts_into_full_blocks(spark, setting):
    points = setting[0]
    cut = blocks.cut_by(points, blocks.morton_code(10.0), 16)
    sizes = {r["block"]: r["count"] for r in cut.groupBy("block").count().collect()}
    assert sizes == {b: 16 if b < 9 else 6 for b in range(10)}
    spread = cut.join(points, "id").groupBy("block").agg(F.stddev("x").alias("s")).agg(F.avg("s")).first()[0]
    assert spread < 2.5  # the whole box has 2.9


@pytest.mark.parametrize("depth", [1, 3])
def test_rounds_match_matrices(spark, setting, depth):
    points, edges, degree, probes, p, y = setting
    before = leftovers(spark)
    cut = blocks.cut_by(points, blocks.morton_code(10.0), 20)
    got = diffusion.return_trace(edges, degree, probes, [0, 1, 2, 7], cut, depth)
    want = {(t, i): 3 * float(y[:, i] @ np.linalg.matrix_power(p, t) @ y[:, i]) for t in (0, 1, 2, 7) for i in range(3)}
    assert {(r["diffusion_time"], r["probe_index"]): r["individual_trace_estimate"] for r in got.collect()} == pytest.approx(want)
    state = blocks.state_after(diffusion.transition(edges, degree), cut, probes, 5, depth)
    found = np.array([[r["y0"], r["y1"], r["y2"]] for r in state.orderBy("id").collect()])
    assert np.allclose(found, np.linalg.matrix_power(p, 5) @ y)
    assert leftovers(spark) == before


def test_only_halo_values_move(spark, setting):
    """A round of steps has one shuffle, of the halo's values: fewer than the states of so many steps."""
    points, edges, degree, probes, _, _ = setting
    cut = blocks.cut_by(points, F.col("x"), 50)
    g = blocks.graph_blocks(diffusion.transition(edges, degree), cut, 2)
    state = blocks.to_blocks(probes, g)
    after = blocks.round_of(state, g, 2, 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = blocks.round_of(state, g, 2, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange SinglePartition" not in plan, plan
    moved = blocks.exchange(state, g).agg(F.sum(F.length("y"))).first()[0]
    halo = g.sends.agg(F.sum(F.size("ids"))).first()[0]
    assert moved == halo * 3 * 8 and after.count() == 3
    diffused = 2 * edges.count() * 3 * 8  # what two joins of edges with states handle
    assert moved < diffused / 5
    blocks.drop_table(state)
    g.drop()


def test_depth_is_lowered_and_hubs_are_refused(spark, setting):
    points, edges, degree, *_ = setting
    walk = diffusion.transition(edges, degree)
    cut = blocks.cut_by(points, blocks.morton_code(10.0), 10).persist()
    one = blocks.halo(walk, cut, 1).filter("layer < 1").join(walk.withColumnRenamed("src", "id"), "id").groupBy("block").count().agg(F.max("count")).first()[0]
    g = blocks.graph_blocks(walk, cut, 3, one)
    assert g.depth == 1
    g.drop()
    with pytest.raises(ValueError, match="would hold"):
        blocks.graph_blocks(walk, cut, 2, one - 1)


def test_many_steps_leave_bounded_disk(spark, setting):
    """64 steps: at most the start, the last state and the one before it are there at any time, and none at the end."""
    points, edges, degree, probes, p, y = setting
    cut = blocks.cut_by(points, blocks.morton_code(10.0), 40)
    before = leftovers(spark)
    g = blocks.graph_blocks(diffusion.transition(edges, degree), cut, 8)
    first, seen = blocks.to_blocks(probes, g), []
    for time, state in blocks.propagate_blocks(g, first, list(range(8, 65, 8)), 3):
        seen.append(len(leftovers(spark)[1] - before[1]))
        last = blocks.from_blocks(state, g, ["y0", "y1", "y2"]).orderBy("id").collect()
        assert np.allclose([[r["y0"], r["y1"], r["y2"]] for r in last], np.linalg.matrix_power(p, time) @ y)
    blocks.drop_table(first)
    g.drop()
    assert max(seen) <= 5 and leftovers(spark) == before
