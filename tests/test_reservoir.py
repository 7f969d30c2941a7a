"""Reservoirs of a stream: the same sample for every dealing of rows to batches, equal to that of the whole table."""

import random

import pytest

from perigraph.operators.selection import uniform_sample
from perigraph.streaming import read_sample, sample_stream

SCHEMA = "id long, v double, name string"


@pytest.mark.parametrize(("files", "per_batch", "shards"), [(1, 1, 1), (7, 1, 3), (7, 3, 16)])
def test_any_dealing(spark, tmp_path, files, per_batch, shards):
    rows = [(i, i / 7, None if i % 5 == 0 else f"n{i}") for i in range(700)]
    random.Random(files).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
    run = lambda: sample_stream(stream, 40, ["id"], str(tmp_path / "out"), str(tmp_path / "checkpoint"), 11, shards).awaitTermination()
    run()
    whole = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, uniform_sample(whole, 40, ["id"], 11).collect()))
    assert sorted(map(tuple, read_sample(spark, str(tmp_path / "out"), 40, SCHEMA).collect())) == want
    run()  # nothing new
    more = spark.createDataFrame([(i, 0.5, "late") for i in range(700, 900)], SCHEMA)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    want = sorted(map(tuple, uniform_sample(whole.union(more), 40, ["id"], 11).collect()))
    assert sorted(map(tuple, read_sample(spark, str(tmp_path / "out"), 40, SCHEMA).collect())) == want


def test_fewer_rows_than_asked_for(spark, tmp_path):
    spark.createDataFrame([(1, 1.0, "a"), (2, None, None)], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    sample_stream(stream, 10, ["id"], str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, read_sample(spark, str(tmp_path / "out"), 10, SCHEMA).collect())) == [(1, 1.0, "a"), (2, None, None)]
