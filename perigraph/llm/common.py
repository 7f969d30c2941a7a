"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch at most, as texts may be long: batches and their copies must fit beside the executor's heap.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: A table is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local sessions get one of
    their own, and clusters an error, as a folder of one machine would lose rows."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="perigraph-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted size is under BROADCAST_BYTES, else df as it is. df should be cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch to BATCH_ROWS and BATCH_BYTES, if they are more or without limit."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def release_memory() -> None:
    """Gives a worker's free memory back to the system, so that idle workers stay small beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library; others have none
    if trim:
        trim(0)


def text_pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, so that clashing extra columns never matter."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(F.col(f"`{text_col}`")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls and the offsets of its rows, without copying."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about most bytes of text; a longer text makes a run of its own."""
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
