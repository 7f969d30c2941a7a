"""Exact deduplication by mergeable counting quotient filters.

Each partition folds the 64-bit fingerprints of its texts into counting quotient filters, one for each slab (the
leading bits of a fingerprint): a quotient's remainders lie sorted in one run of slots. Filters of a slab merge without
loss, as sorted remainders whose counts add up. Only texts whose fingerprint has a count above one are compared byte by
byte; of all other documents no text leaves its partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_side, text_pieces

QUOTIENT_BITS = 8
#: Distinct fingerprints that one slab holds on average.
SLAB_ROWS = 1 << 16
#: Fingerprints that a partition folds at once.
FOLD_ROWS = 1 << 21


def slab_bits_for(rows: int) -> int:
    return max(1, min(40, math.ceil(math.log2(max(2, rows / SLAB_ROWS)))))


def cqf_encode(keys: np.ndarray, counts: np.ndarray, remainder_bits: int) -> bytes:
    """A counting quotient filter of sorted distinct keys of QUOTIENT_BITS + remainder_bits bits.

    Header (slots), occupied bit per quotient, then per slot a run-end bit and a counter bit, then the slots. A key with
    a count above one has a counter slot after its remainder.
    """
    many = counts > 1
    slots = np.arange(len(keys)) + np.cumsum(many) - many
    total = len(keys) + int(many.sum())
    quotient = (keys >> np.uint64(remainder_bits)).astype(np.int64)
    values = np.zeros(total, np.uint64)
    values[slots] = keys & np.uint64((1 << remainder_bits) - 1)
    counter = np.zeros(total, bool)
    counter[slots[many] + 1] = True
    values[slots[many] + 1] = counts[many]
    run_end = np.zeros(total, bool)
    last = np.append(quotient[1:] != quotient[:-1], True)
    run_end[slots[last] + many[last]] = True
    occupied = np.zeros(1 << QUOTIENT_BITS, bool)
    occupied[quotient] = True
    return np.int64(total).tobytes() + b"".join(np.packbits(x).tobytes() for x in (occupied, run_end, counter)) + values.tobytes()


def cqf_decode(blob: bytes, remainder_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and counts of a filter."""
    total = int(np.frombuffer(blob, np.int64, 1)[0])
    at, bits = 8, []
    for n in (1 << QUOTIENT_BITS, total, total):
        size = (n + 7) // 8
        bits.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n).astype(bool))
        at += size
    occupied, run_end, counter = bits
    values = np.frombuffer(blob, np.uint64, total, at)
    run = np.cumsum(run_end) - run_end
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    counts = np.ones(total, np.uint64)
    counts[np.flatnonzero(counter) - 1] = values[counter]
    return ((quotient << np.uint64(remainder_bits)) | values)[~counter], counts[~counter]


def cqf_merge(blobs: list[bytes], remainder_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges filters without loss."""
    parts = [cqf_decode(x, remainder_bits) for x in blobs]
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    unique, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(len(unique), np.uint64)
    np.add.at(total, inverse, counts)
    return unique, total


def repeated_fingerprints(fingerprints: DataFrame, slab_bits: int) -> DataFrame:
    """The values of the long column fp that occur more than once."""
    remainder_bits = 64 - slab_bits - QUOTIENT_BITS
    low = 64 - slab_bits

    def fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(values: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(values), return_counts=True)
            slabs, starts = np.unique(keys >> np.uint64(low), return_index=True)
            ends = [*starts[1:], len(keys)]
            own = keys & np.uint64((1 << low) - 1)
            blobs = [cqf_encode(own[a:b], counts[a:b].astype(np.uint64), remainder_bits) for a, b in zip(starts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(slabs.astype(np.int64)), pa.array(blobs, pa.binary())], names=["slab", "filter"])

        held, n = [], 0
        for batch in rows:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += batch.num_rows
            if n >= FOLD_ROWS:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    def merge(table: pa.Table) -> pa.Table:
        slab = np.uint64(table.column("slab")[0].as_py())
        keys, counts = cqf_merge(table.column("filter").to_pylist(), remainder_bits)
        keys = keys[counts > 1] | (slab << np.uint64(low))
        return pa.table({"fp": pa.array(keys.view(np.int64))})

    return fingerprints.select("fp").mapInArrow(fold, "slab long, filter binary").groupBy("slab").applyInArrow(merge, "fp long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest id stays. A null text counts as
    empty, empty texts are equal to each other. Null ids are smaller than any other; rows that repeat an id and its
    text are kept or dropped together and count one by one in group_size. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    texts = text_pieces(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    texts = texts.withColumn("fp", F.xxhash64("norm"))
    repeated = materialize(repeated_fingerprints(texts, slab_bits_for(docs.count())), "repeated-fingerprints")
    # Byte verification: the texts themselves are the grouping key, combined before they are shuffled.
    verified = (
        texts.join(small_side(repeated, 16), "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    digests = texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256"))
    joined = digests.join(verified, ["fp", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
