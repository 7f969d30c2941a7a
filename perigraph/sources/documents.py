"""Nested JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def first_path(df: DataFrame, paths: list[str]) -> Column:
    """The value at the first dotted path that the schema has, then the next where it is null."""
    present = []
    for path in paths:
        kind = df.schema
        for part in path.split("."):
            fields = {f.name: f.dataType for f in getattr(kind, "fields", [])}
            if part not in fields:
                break
            kind = fields[part]
        else:
            present.append(F.col(path))
    if not present:
        raise ValueError(f"none of {paths} is there")
    return F.coalesce(*present)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document per row; fails if the path is there."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("error").text(path)
