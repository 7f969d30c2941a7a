"""Text tables, directories of them, and checked writes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import score_columns
from ..session import require
from .arrays import opened
from .stores import file_handle, head_of, listed


def read_commented_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A table of numbers between white space, lines with # left out; rows that are not all finite and positive go."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter("trim(value) != '' and not startswith(trim(value), '#')")
    out = lines.select(*[F.expr(f"try_cast(get(split(trim(value), '\\\\s+'), {i}) as double)").alias(n) for i, n in enumerate(names)], F.size(parts).alias("_n")).drop("_n")
    for n in names:
        out = out.filter(F.col(n).isNotNull() & ~F.isnan(n) & (F.col(n) > 0) & (F.col(n) < float("inf")))
    return out


def require_increasing(table: DataFrame, column: str) -> DataFrame:
    """The table, if no value of the column stands twice."""
    require(table.groupBy(column).count().filter("count > 1").isEmpty(), f"{column} repeats a value")
    return table


def read_probe_directory(spark: SparkSession, path: str, schema: str, pattern: str = r"/t0*([0-9]+)[^/]*(/part-[^/]*)?$", time: str = "diffusion_time") -> DataFrame:
    """CSV files of probe traces whose names, or whose folders' names, hold their time; raises where a row's time is another."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"))
    rows = rows.withColumn("_named", F.regexp_extract("file", pattern, 1)).withColumn("file_time", F.expr("try_cast(_named as int)")).drop("_named")
    odd = rows.filter(F.col("file_time").isNull() | (F.col("file_time") != F.col(time))).limit(1).collect()
    require(not odd, f"{odd and odd[0]['file']} holds another time than its name")
    return rows.drop("file_time")


def discover_tables(spark: SparkSession, root: str, roles: dict[str, list[str]]) -> list[tuple[int, str]]:
    """CSV files below root by how many roles their header can fill, best first. Only the beginning of a file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    found = []
    for r in files.toLocalIterator():  # names only; a header is read by the driver, like any schema
        head = head_of(spark, r["path"], 1 << 16).decode("utf-8", "replace").splitlines()[:1]
        found.append((score_columns([c.strip().strip('"') for c in (head or [""])[0].split(",")], roles), r["path"]))
    return sorted(found, key=lambda x: (-x[0], x[1]))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header in every part, parts and rows in order; fails if the path is there."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("error").option("header", True).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files of any size, each streamed by the task that holds its name, a megabyte at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for name in batch["path"]:
                system, where = opened(name)
                digest = hashlib.sha256()
                with system.open_input_stream(where) as file:
                    while block := file.read(1 << 20):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield batch.assign(sha256=digests)

    names = listed(spark, path)
    files = spark.createDataFrame(names, "path string, length long").repartition(max(1, min(len(names), 1000)))
    return files.mapInPandas(run, "path string, length long, sha256 string")


def checked_write(df: DataFrame, path: str, expected_rows: int | None = None) -> int:
    """Writes Parquet where nothing is yet, and holds the rows written against what was expected."""
    df.write.mode("error").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    require(expected_rows is None or n == expected_rows, f"{n} rows were written, not {expected_rows}")
    return n


def append_times(df: DataFrame, path: str, key: tuple[str, ...] = ("diffusion_time", "probe_index")) -> int:
    """Appends the rows whose key the table at path lacks; returns how many. Running it again adds nothing."""
    spark = df.sparkSession
    system, where = file_handle(spark, path)
    if system.exists(where):
        df = df.join(spark.read.parquet(path).select(*key), list(key), "left_anti")
    df = df.persist()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n
