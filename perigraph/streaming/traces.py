"""Probe traces that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import append_times

SCHEMA = "graph string, diffusion_time int, probe_index int, individual_trace_estimate double"


def trace_stream(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def ingest_traces(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new in the folder to the table, once per time and probe, and ends. Repeating a batch adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        append_times(batch.dropDuplicates(["diffusion_time", "probe_index"]), table)

    return trace_stream(spark, folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_summary(stream: DataFrame) -> DataFrame:
    """Per time of a stream of traces: probes so far, mean and standard error."""
    v = "individual_trace_estimate"
    return stream.groupBy("diffusion_time").agg(F.count(F.lit(1)).alias("n_probes"), F.avg(v).alias("trace_mean"), (F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("trace_se"))
