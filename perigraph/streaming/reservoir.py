"""A uniform sample of a stream, kept as mergeable reservoirs in the state of a streaming query.

Every row has a draw, the hash of its key; a reservoir holds the n rows with the least draws, so reservoirs of any parts
merge into that of the whole, and the sample is the same however rows are dealt to batches, tasks and shards. Tasks keep n
rows of a batch at most before anything is shuffled, and each shard's state n rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import hash_uniform

HELD = "shard int, draw double, row string"


def least(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    return rows.sort_values(["draw", "row"], kind="stable").head(n)


def reservoirs(rows: DataFrame, n: int, key: list[str], seed: int = 0, shards: int = 16, draw: Column | None = None) -> DataFrame:
    """shard, draw, row (JSON) of a stream: whenever a shard changes, its whole reservoir. A draw of one's own may stand for
    the hash of the key."""
    draw = hash_uniform(F.lit(seed), *[F.col(k) for k in key]) if draw is None else draw.cast("double")
    shard = F.pmod(F.xxhash64(F.lit("shard"), *[F.col(k) for k in key]), F.lit(shards)).cast("int")
    drawn = rows.select(shard.alias("shard"), draw.alias("draw"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"))

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = least(batch if held is None else pd.concat([held, batch]), n)
        if held is not None:
            yield held

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame({"draw": state.get[0], "row": state.get[1]})] if state.exists else []
        for batch in batches:
            parts = [least(pd.concat([*parts, batch[["draw", "row"]]]), n)]
        held = parts[0]
        state.update((held["draw"].tolist(), held["row"].tolist()))
        yield held.assign(shard=key[0])[["shard", "draw", "row"]]

    return drawn.mapInPandas(of_task, HELD).groupBy("shard").applyInPandasWithState(merge, HELD, "draws array<double>, rows array<string>", "update", GroupStateTimeout.NoTimeout)


def sample_stream(rows: DataFrame, n: int, key: list[str], table: str, checkpoint: str, seed: int = 0, shards: int = 16, draw: Column | None = None) -> StreamingQuery:
    """Reads what there is and ends; reservoirs that changed are written under the batch's number, and over it if repeated."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return reservoirs(rows, n, key, seed, shards, draw).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sample(spark: SparkSession, table: str, n: int, schema: str) -> DataFrame:
    """The sample of all that was read so far: each shard's last reservoir, merged."""
    held = spark.read.parquet(table)
    last = held.groupBy("shard").agg(F.max("batch").alias("batch"))  # a row for each shard
    merged = held.join(F.broadcast(last), ["shard", "batch"]).orderBy("draw", "row").limit(n)
    return merged.select(F.from_json("row", schema).alias("r")).select("r.*")
