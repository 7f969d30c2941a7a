"""Files in any store that Spark reads, by the driver: names and headers only."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_handle(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path, for any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def head_of(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file."""
    system, where = file_handle(spark, path)
    stream = spark.sparkContext._jvm.java.io.DataInputStream(system.open(where))
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and length of the files that a path, a folder or a pattern names, empty ones too (Spark's readers skip those)."""
    system, where = file_handle(spark, path)
    found = list(system.globStatus(where) or [])
    if len(found) == 1 and found[0].isDirectory():
        found = list(system.listStatus(found[0].getPath()))
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.isFile() and f.getPath().getName()[:1] not in "._")
