"""Readers, checked writes, streaming and whole plans."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigraph import plans, sources
from perigraph.operators import spatial
from perigraph.sources.files import append_times
from perigraph.streaming import ingest_traces, running_summary


def test_commented_table(spark, tmp_path):
    (tmp_path / "t.dat").write_text("# k P\n 0.1  5\n0.2 inf\n\n0.3 -1\nx y\n  0.4\t7 # \n")
    got = sources.read_commented_table(spark, str(tmp_path / "t.dat"), ["k", "p"]).collect()
    assert [tuple(r) for r in got] == [(0.1, 5.0), (0.4, 7.0)]


def test_binary_points_and_arrays(spark, tmp_path):
    xyz = np.arange(30, dtype="<f4").reshape(10, 3)
    xyz.tofile(tmp_path / "p.bin")
    got = sources.read_points(spark, str(tmp_path / "p.bin")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(map(float, r)) for r in xyz]
    np.save(tmp_path / "a.npy", xyz)
    assert sources.read_array(spark, str(tmp_path / "a.npy")).filter("row = 3 and col = 1").first()["value"] == 10.0
    np.savez(tmp_path / "m.npz", indptr=[0, 2, 2, 3], indices=[1, 2, 0], data=[1.0, 2.0, 3.0])
    assert sorted(map(tuple, sources.read_sparse_matrix(spark, str(tmp_path / "m.npz")).collect())) == [(0, 1, 1.0), (0, 2, 2.0), (2, 0, 3.0)]


def test_digests_of_long_files(spark, tmp_path):
    """Files of over 2 GB (with holes) and of no byte, each in one stream."""
    import hashlib

    for name, size in (("long.bin", (1 << 31) + 17), ("none.bin", 0), ("some.bin", 5)):
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)
    want = hashlib.sha256()
    for _ in range(1 << 11):
        want.update(bytes(1 << 20))
    want.update(bytes(17))
    got = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["sha256"]) for r in sources.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"long.bin": ((1 << 31) + 17, want.hexdigest()), "none.bin": (0, hashlib.sha256(b"").hexdigest()), "some.bin": (5, hashlib.sha256(bytes(5)).hexdigest())}


def test_probe_directory_checks_names(spark, tmp_path):
    folder = tmp_path / "probes"
    folder.mkdir()
    (folder / "trace_t000512.csv").write_text("graph,diffusion_time,probe_index,individual_trace_estimate\ng,512,0,1.5\n")
    schema = "graph string, diffusion_time int, probe_index int, individual_trace_estimate double"
    assert sources.read_probe_directory(spark, str(folder), schema, "t0*([0-9]+)[.]").count() == 1
    (folder / "trace_t000640.csv").write_text("graph,diffusion_time,probe_index,individual_trace_estimate\ng,641,0,1.5\n")
    with pytest.raises(ValueError):
        sources.read_probe_directory(spark, str(folder), schema, "t0*([0-9]+)[.]")
    best = sources.discover_tables(spark, str(tmp_path), {"t": ["diffusion_time"], "x": ["nothing"]})
    assert best[0][0] == 1 and len(best) == 2
    assert sources.file_digests(spark, str(folder)).filter("length(sha256) = 64").count() == 2


def test_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"a": {"b": None, "c": 2}}, indent=1))
    df = sources.read_document(spark, str(tmp_path / "d.json"))
    assert df.select(sources.first_path(df, ["a.x", "a.b", "a.c"])).first()[0] in (2, "2")
    sources.write_document(df, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        sources.first_path(df, ["z"])


def test_checked_write_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0)], "diffusion_time int, probe_index int, v double")
    with pytest.raises(ValueError):
        sources.checked_write(df, str(tmp_path / "w"), 3)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sources.checked_write(df, str(tmp_path / "w"))
    path = str(tmp_path / "t")
    assert append_times(df, path) == 2 and append_times(df, path) == 0


def test_stream_ingests_once(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    head = "graph,diffusion_time,probe_index,individual_trace_estimate\n"
    (folder / "a.csv").write_text(head + "g,1,0,2.0\ng,1,1,4.0\ng,1,1,4.0\n")
    for _ in range(2):
        ingest_traces(spark, str(folder), table, str(tmp_path / "cp")).awaitTermination()
    (folder / "b.csv").write_text(head + "g,1,1,4.0\ng,2,0,5.0\n")
    ingest_traces(spark, str(folder), table, str(tmp_path / "cp")).awaitTermination()
    got = running_summary(spark.read.parquet(table)).orderBy("diffusion_time").collect()
    assert [(r["diffusion_time"], r["n_probes"], r["trace_mean"]) for r in got] == [(1, 2, 3.0), (2, 1, 5.0)]


def test_plans_run_end_to_end(spark):
    rng = np.random.default_rng(4)
    data = [(i, *map(float, rng.random(3) * 10), float(v)) for i, v in enumerate(rng.random(400))]
    catalogue = spark.createDataFrame(data, "id long, x double, y double, z double, mass double")
    points, edges = plans.catalogue_to_graph(catalogue, "mass", 0.2, 10.0, k=4)
    assert points.count() == 200 and edges.groupBy("src").count().agg(F.min("count")).first()[0] >= 4
    times = [4, 6, 8, 12, 16, 24, 32, 48, 64, 96]
    trace = spark.createDataFrame([(p, t, float((1 + 0.01 * rng.random()) * t**-1.5)) for p in range(8) for t in times], "probe_index int, diffusion_time int, individual_trace_estimate double")
    scale = plans.transport_scale(trace, 20, 8, 10.0, 0.02, width=5, tolerance=0.1).persist()
    assert scale.count() == 20 and scale.filter("radius is not null").count() == 20
    sweep = plans.truncation_sweep(trace, 10, 8, [32, 96], width=5, tolerance=0.1)
    assert sweep.count() == 2
    centres = plans.flows.numbered_centres(points, 10)
    counts = spatial.counts_in_spheres(centres, points.withColumn("id", F.col("id") + 1000), [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0], 10.0, 9)
    ratio = plans.density_transport_ratio(counts, 0.2, scale, 10, 10).first()
    assert ratio is not None
