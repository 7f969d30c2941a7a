"""The array source and sink: any length, any block, members of bundles, published at once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigraph import sources
from perigraph.sources import arrays


def in_process(layout, path, member=None, columns=None, matrix=False):
    """All rows by the reader itself, so that small blocks and ranges can be set."""
    columns = columns or [c.split()[0] for c in arrays.SCHEMAS[layout].split(", ")]
    reader = arrays.ArrayReader(layout, str(path), member, columns)
    pieces = reader.partitions()
    rows = [tuple(r.values()) for p in pieces for batch in reader.read(p) for r in batch.to_pylist()]
    return rows, pieces


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK", 64)
    monkeypatch.setattr(arrays, "RANGE", 200)


def test_prime_numbers_of_points_come_in_whole_blocks(spark, tmp_path, small):
    xyz = np.random.default_rng(1).random((1009, 3), np.float32)  # a prime number of rows
    xyz.tofile(tmp_path / "p.bin")
    rows, pieces = in_process("points", tmp_path / "p.bin")
    assert [r[0] for r in rows] == list(range(1009)) and np.array_equal(np.array([r[1:] for r in rows], np.float32), xyz)
    assert len(pieces) == -(-1009 // (200 // 12)) and max(p.end - p.start for p in pieces) == 16
    assert in_process("points", tmp_path / "p.bin", columns=["y"])[0] == [(float(v),) for v in xyz[:, 1]]
    got = sources.read_points(spark, str(tmp_path / "p.bin"), ["id", "z"])
    assert got.columns == ["id", "z"] and np.array_equal(np.array([r["z"] for r in got.orderBy("id").collect()], np.float32), xyz[:, 2])
    (tmp_path / "odd.bin").write_bytes(b"x" * 13)
    with pytest.raises(ValueError, match="no multiple of 12"):
        in_process("points", tmp_path / "odd.bin")


def test_long_files_are_cut_into_ranges(tmp_path):
    """A prime number of points, 100 MB: two ranges, blocks of a megabyte."""
    with open(tmp_path / "long.bin", "wb") as f:
        f.truncate(12 * 8_388_617)
    reader = arrays.ArrayReader("points", str(tmp_path / "long.bin"), None, ["id", "x"])
    pieces = reader.partitions()
    assert len(pieces) == 2 and pieces[0].start == 0 and pieces[-1].end == 8_388_617
    batches = [b.num_rows for b in reader.read(pieces[1])]
    assert sum(batches) == pieces[1].end - pieces[1].start and max(batches) <= (1 << 20) // 12 + 1


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("order", ["C", "F"])
def test_arrays_and_bundles(spark, tmp_path, small, save, order):
    a = np.asarray(np.arange(331 * 3, dtype="i4").reshape(331, 3), order=order)
    b = np.linspace(0, 1, 997)
    want = {(i, j, float(a[i, j])) for i in range(331) for j in range(3)}
    np.save(tmp_path / "a.npy", a)
    save(tmp_path / "m.npz", a=a, b=b, none=np.zeros(0))
    for rows, pieces in (in_process("array", tmp_path / "a.npy"), in_process("bundle", tmp_path / "m.npz", "a")):
        assert len(rows) == len(want) and set(rows) == want
    assert (len(pieces) == 1) == (save is np.savez_compressed)
    assert in_process("bundle", tmp_path / "m.npz", "b")[0] == [(i, 0, v) for i, v in enumerate(b)]
    assert in_process("bundle", tmp_path / "m.npz", "none")[0] == []
    assert {tuple(r) for r in sources.read_bundle(spark, str(tmp_path / "m.npz"), "a").collect()} == want
    assert sources.read_array(spark, str(tmp_path / "a.npy"), ["value"]).agg(F.sum("value")).first()[0] == a.sum()
    (tmp_path / "short.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-4])
    with pytest.raises(ValueError, match="bytes, not"):
        in_process("array", tmp_path / "short.npy")


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_matrices(spark, tmp_path, small, save):
    """Empty rows, at both ends too, and one row that spans many ranges."""
    rng = np.random.default_rng(2)
    lengths = np.array([0, 0, 3, 0, 500, 1, 0, 0, 7, *rng.integers(0, 4, 60), 0, 0])
    indptr, n = np.concatenate([[0], np.cumsum(lengths)]), int(lengths.sum())
    indices, data = rng.integers(0, 70, n).astype("i4"), rng.random(n).astype("f4")
    save(tmp_path / "m.npz", indptr=indptr, indices=indices, data=data, shape=np.array([71, 71]))
    want = list(zip(np.repeat(np.arange(len(lengths)), lengths).tolist(), indices.tolist(), data.astype(float).tolist(), strict=True))
    rows, pieces = in_process("matrix", tmp_path / "m.npz")
    assert rows == want and (len(pieces) > 10 or save is np.savez_compressed)
    assert sorted(map(tuple, sources.read_sparse_matrix(spark, str(tmp_path / "m.npz")).collect())) == sorted(want)
    np.savez(tmp_path / "e.npz", indptr=np.zeros(5, int), indices=np.zeros(0, int), data=np.zeros(0))
    assert in_process("matrix", tmp_path / "e.npz")[0] == []
    edges = spark.createDataFrame(want, "src long, dst long, w double").dropDuplicates(["src", "dst"])
    sources.write_sparse_matrix(edges, str(tmp_path / "out"), save is np.savez_compressed)
    assert sources.read_sparse_matrix(spark, str(tmp_path / "out")).exceptAll(edges).isEmpty()
    assert sources.read_sparse_matrix(spark, str(tmp_path / "out")).count() == edges.count()


@pytest.mark.parametrize("compress", [False, True])
def test_matrices_of_rows_far_apart(spark, tmp_path, small, compress):
    """Keys that were shifted by 10**12: a part keeps the numbers of its rows, not a pointer for each number between them."""
    want = [(10**12 * (i // 40) + i % 40, 7 * j, float(i + j)) for i in range(120) for j in range(i % 5)]
    edges = spark.createDataFrame(want, "src long, dst long, w double").repartition(3)
    sources.write_sparse_matrix(edges.coalesce(1), str(tmp_path / "out"), compress)
    assert in_process("matrix", tmp_path / "out")[0] == want
    assert sorted(map(tuple, sources.read_sparse_matrix(spark, str(tmp_path / "out")).collect())) == want
    assert sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(tmp_path / "out")) < 1 << 16


def test_parts_are_published_at_once(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "cast(id as float) as x", "cast(id / 2 as float) as y", "cast(-id as float) as z")
    path = str(tmp_path / "points")
    broken = rows.withColumn("x", F.expr("if(id = 777, cast(raise_error('killed') as float), x)"))
    with pytest.raises(Exception, match="killed"):
        sources.write_points(broken, path)
    assert not os.path.exists(path) and os.listdir(tmp_path) == []
    os.makedirs(tmp_path / "points.writing-of-a-killed-run")
    sources.write_points(rows, path)
    assert sources.read_points(spark, path).exceptAll(rows).isEmpty() and sources.read_points(spark, path).count() == 1000
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".bin")) == 12 * 1000
    with pytest.raises(Exception, match="is there already"):
        sources.write_points(rows, path)
    assert sources.remove_unfinished(path) == 1 and os.listdir(tmp_path) == ["points"]


def test_lost_bytes_are_noticed(tmp_path):
    """The commit compares the size of each part with what was counted, and leaves files of other attempts out."""
    import pyarrow as pa

    writer = arrays.ArrayWriter("array", str(tmp_path / "a"), False)
    system, folder = arrays.opened(writer.folder)
    system.create_dir(folder)
    batch = pa.RecordBatch.from_arrays([pa.array([1.0, 2.0])], names=["v"])
    size = writer.put(system, f"{folder}/part-0.npy", batch)
    writer.put(system, f"{folder}/part-0-again.npy", batch)
    with pytest.raises(ValueError, match="bytes, not"):
        writer.commit([arrays.Written([("part-0.npy", 2, size + 1)])])
    assert not os.path.exists(tmp_path / "a")
    writer.commit([arrays.Written([("part-0.npy", 2, size)]), None])
    assert sorted(os.listdir(tmp_path / "a")) == ["_rows.json", "part-0.npy"]


def test_parts_are_bounded_in_bytes():
    """Rows of many columns make parts of fewer rows, so a task's memory does not grow with its rows nor their width."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 10_000)) for _ in range(5)], names=list("abcde")) for i in range(0, 500_000, 10_000)]
    parts = list(arrays.in_parts(iter(batches)))
    assert max(p.nbytes for p in parts) <= arrays.PART_BYTES < sum(p.nbytes for p in parts)
    assert np.array_equal(np.concatenate([p["e"].to_numpy() for p in parts]), np.arange(500_000))


def test_array_and_bundle_sinks(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "cast(id * id as double) as a", "cast(-id as double) as b").repartition(7)
    sources.write_array(rows, str(tmp_path / "a"), ["id"], ["a", "b"])
    got = sources.read_array(spark, str(tmp_path / "a"))
    assert {(r["row"], r["col"]): r["value"] for r in got.collect()} == {(i, c): float(i * i if c == 0 else -i) for i in range(500) for c in (0, 1)}
    sources.write_bundle(rows, str(tmp_path / "b"), ["id"])
    got = sources.read_bundle(spark, str(tmp_path / "b"), "b")
    assert {(r["row"], r["value"]) for r in got.collect()} == {(i, float(-i)) for i in range(500)}
    sources.write_array(rows.limit(0), str(tmp_path / "none"), ["id"], ["a"])
    assert sources.read_array(spark, str(tmp_path / "none")).count() == 0
