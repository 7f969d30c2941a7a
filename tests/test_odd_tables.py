"""Queries over tables that are larger or odder than the given ones: coincident points, keys of any size, small drivers."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from perigraph.operators import bootstrap, synthetic, tree
from perigraph.queries import ORACLE_SQL, QUERIES

from .test_queries import rows


@pytest.fixture
def parts(spark, tmp_path):
    """A folder whose part table has the keys given, and its SQL, over keys of 128 bits, as the SQL's products overflow in 64."""

    def write(keys):
        spark.createDataFrame([(k,) for k in keys], "p_partkey long").repartition(3).write.parquet(str(tmp_path / "part.parquet"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW part AS SELECT p_partkey::HUGEINT AS p_partkey FROM '{tmp_path}/part.parquet/*.parquet'")
        return str(tmp_path), con

    return write


def same(spark, name, folder, con):
    got, want = QUERIES[name](spark, folder).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("keys", [[*range(1, 60), 1000003 + 5], []], ids=["coincident", "empty"])
def test_radii(spark, parts, keys):
    """Two points at one place: the least distance is zero, from which no ratio leads on."""
    same(spark, "k4_radii", *parts(keys))


def test_mesh_at_points_sends_no_points(spark, parts):
    """Neither are points copied to their corners nor broadcast; a mesh too large to broadcast is merged with them."""
    folder, con = parts(range(1, 300))
    same(spark, "n5_mesh_at_points", folder, con)
    points, cells = spark.range(100).selectExpr("id", "id % 7 / 7D as x", "id % 11 / 11D as y", "id % 13 / 13D as z"), spark.range(4096)
    field = cells.selectExpr("cast(id div 256 as int) as ix", "cast(id div 16 % 16 as int) as iy", "cast(id % 16 as int) as iz", "sin(id) as v")
    small = synthetic.mesh_at_points(points, field, 16, 1.0)
    plan = small._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(synthetic, "BROADCAST_BYTES", 0)
        large = synthetic.mesh_at_points(points, field, 16, 1.0)
    assert "SortMergeJoin" in large._jdf.queryExecution().sparkPlan().toString()
    assert rows(small.toPandas()) == rows(large.toPandas())


def test_draws_of_many_units(spark):
    """Products of a unit's number and the rule's factors leave 32 bits from 271,000 units on."""
    n = 300_000
    b, i = np.divmod(np.arange(2 * n), n)
    want = (b * 1103 + i * 7919 + b * i * 31 + b * b * 17) % 10007 % n
    got = bootstrap.multiplicities(bootstrap.lattice_draws(spark, 2, n)).toPandas()
    assert {(r.b, r.unit): r.c for r in got.itertuples()} == {(b, u): int(c) for b in (0, 1) for u, c in zip(*np.unique(want[b * n : (b + 1) * n], return_counts=True), strict=True)}


def test_counts_are_taken_around_drawn_centres_only(spark, monkeypatch):
    """The replicates draw 10,007 of all centres at most, and no others are searched around."""
    from perigraph.queries import physical

    around = []
    real = physical.spatial.counts_in_spheres
    monkeypatch.setattr(physical.spatial, "counts_in_spheres", lambda centres, *a: (around.append(centres.count()), real(centres, *a))[1])
    drawn = spark.createDataFrame([(0, 3, 1), (1, 5, 2), (1, 3, 1)], "b long, unit int, c long")
    some = physical.centre_counts(spark, "/root/testdata/sf0.001", drawn)
    every = physical.centre_counts(spark, "/root/testdata/sf0.001").filter("center in (3, 5)")
    assert around[0] == 2 and rows(some.toPandas()) == rows(every.toPandas())


@pytest.mark.parametrize("scale", [10.0, 1e6])
def test_counts_within(scale):
    """Points of a grid lie at the very radii; some crowd together, some share a place; radii reach to half the box."""
    rng = np.random.default_rng(1)
    own, there = (np.concatenate([rng.random((n, 3)), np.round(rng.random((n, 3)) * 10) / 10 % 1, 0.33 + rng.random((n, 3)) / 1000, np.full((n, 3), 0.7)]) * scale for n in (70, 130))
    own, there = own[tree.tile_order(own)], [part[tree.tile_order(part)] for part in (there[:1], there[1:150], there[150:])]
    squares = np.array([0.0005, 0.1, 0.2, 0.3, 0.4, 0.499]) ** 2 * scale**2
    d2 = tree.distances2(own, np.concatenate(there), scale)
    assert (tree.counts_within(own, there, squares, scale) == np.stack([(d2 <= s).sum(axis=1) for s in squares], axis=1)).all()


def test_points_travel_to_few_blocks(spark, monkeypatch):
    """Each leaf of packed points is sent to at most LEAVES others or so, not to all leaves of 256 points within the radius."""
    sent = []
    real = tree.chunked
    monkeypatch.setattr(tree, "chunked", lambda *a: (sent.append(out := real(*a)), out)[1])
    points = spark.range(30_000).select("id", *[F.rand(s).alias(c) for s, c in enumerate("xyz")])
    got = tree.tree_counts(points, points, [0.1, 0.45], 1.0)
    assert got.count() == 60_000
    assert sent[0].agg(F.sum(F.length("other_ids") / 8)).first()[0] <= 64 * 30_000


def test_many_neighbours_have_near_bounds(spark, monkeypatch):
    """Eighths of a cell of 337 points hold fewer than 48, so their points had no bound of their own and met nearly all others."""
    found = []
    real = tree.meet
    monkeypatch.setattr(tree, "meet", lambda *a, **b: (found.append(out := real(*a, **b)), out)[1])
    n, k = 2700, 48
    xyz = np.random.default_rng(2).random((n, 3))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    got = tree.tree_neighbours(points, k, 1.0).filter(f"rank = {k}").toPandas()
    want = np.sort(tree.distances2(xyz, xyz, 1.0), axis=1)[:, k]
    assert len(got) == n and np.allclose(got.sort_values("src").dist, np.sqrt(want))
    assert found[0].count() <= 10 * k * n
