"""SimHash near-duplicates by pivot distance tables.

The Hamming distances to fixed reference fingerprints (pivots) are computed once per fingerprint. A pair is discarded
when some coordinate differs by more than the link distance (triangle inequality), and what survives is verified by its
exact distance. Pivots alone would leave a constant share of all pairs, so pairs first meet in groups.

Fingerprints within 3 bits of each other agree on at least 3 of 6 blocks of bits, so every pair that can link meets in
one of 20 groups of equal bits; groups of one fingerprint end there. A group of more than PAIR_GROUP fingerprints is split
in the same manner: of 6 blocks of the bits that are still free, a pair that links agrees on at least 3. After three
splits at most 9 bits are free, so no group holds over 512 fingerprints, whatever the data. All pairs of all groups go
through the pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, text_pieces, utf8
from .components import connected_components

BITS, LINK_DISTANCE, SHINGLE_WORDS, SEED = 64, 3, 3, 42
BLOCKS, AGREEING = 6, 3
PIVOTS = 16
#: Fingerprints of a group at most; larger groups are split, which must be possible: no less than 512.
PAIR_GROUP = 2048
#: Shingles whose bits are counted at once.
COUNT_SHINGLES = 1 << 17


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def finer(mask: int) -> list[int]:
    """Masks that add bits to mask. Fingerprints that agree on mask and link agree on one of these, too."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    edges = [len(free) * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [mask | sum(x) for x in combinations(blocks, AGREEING)]


def pivots() -> list[int]:
    """Fixed reference fingerprints."""
    return [signed(xxhash.xxh64_intdigest(f"pivot {i}", SEED)) for i in range(PIVOTS)]


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each word shingle of a text; the whole sequence if it is shorter; nothing if there is no word."""
    words = text.lower().split()  # for bytes, both know ASCII only
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1])
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


def fold(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprints of texts with these shingle hashes: a bit is 1 if set in over half of them."""
    counts, flat = np.array([len(x) for x in hashes], np.int64), np.array([y for x in hashes for y in x], np.uint64)
    ones = np.zeros((len(hashes), BITS), np.int64)
    owner = np.repeat(np.arange(len(hashes)), counts)
    for at in range(0, len(flat), COUNT_SHINGLES):
        part, own = flat[at : at + COUNT_SHINGLES], owner[at : at + COUNT_SHINGLES]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of every whole text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, offsets = utf8(batch.column(1))
            data, prints, held, n = data.tobytes(), [], [], 0
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                held.append(shingle_hashes(data[a:b]))
                n += len(held[-1])
                if n >= COUNT_SHINGLES:
                    prints.append(fold(held))
                    held, n = [], 0
            prints.append(fold(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "fp"])

    texts = text_pieces(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fp long")


def groups(prints: DataFrame) -> DataFrame:
    """mask, bits, fp: groups of 2 to PAIR_GROUP fingerprints of equal bits under a mask; each pair that links meets in one.
    prints holds different values of fp."""
    spark, masks, found = prints.sparkSession, [0], []
    split = prints.select("fp", F.array(*[F.lit(signed(x)) for x in finer(0)]).alias("finer"))
    while True:
        keyed = split.select("fp", F.explode("finer").alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        if found:  # finer masks of several groups may be one
            keyed = keyed.distinct()
        # Groups are counted apart, so that one with many fingerprints is combined before it is shuffled.
        counts = materialize(keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-counts")
        met = materialize(keyed.join(small_side(counts, 40), ["mask", "bits"]), "simhash-groups")
        found.append(met.filter(F.col("n") <= PAIR_GROUP).select("mask", "bits", "fp"))
        if counts.filter(F.col("n") > PAIR_GROUP).isEmpty():
            return reduce(DataFrame.unionByName, found)
        masks = sorted({x for mask in masks for x in finer(mask)})
        table = spark.createDataFrame([(signed(x), [signed(y) for y in finer(x)]) for x in masks], "mask long, finer array<long>")
        split = met.filter(F.col("n") > PAIR_GROUP).select("mask", "fp").join(F.broadcast(table), "mask")  # 20, then at most 400 rows


def candidates(prints: DataFrame) -> DataFrame:
    """a, b, discarded: all pairs of all groups, and whether their distances to some pivot differ by more than the link
    distance. A pair comes once for each group that it meets in. For links, Spark discards within the join."""
    table = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots()])
    paired = groups(prints).withColumn("pivot", table)
    a, b = paired.alias("a"), paired.alias("b")
    same = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.bits") == F.col("b.bits"))
    discarded = F.expr(" or ".join(f"abs(a.pivot[{i}] - b.pivot[{i}]) > {LINK_DISTANCE}" for i in range(PIVOTS)))
    return a.join(b, same & (F.col("a.fp") < F.col("b.fp"))).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), discarded.alias("discarded"))


def links(prints: DataFrame) -> DataFrame:
    """All pairs (a, b) of different values of fp, a < b, within LINK_DISTANCE bits, each once."""
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_DISTANCE
    return candidates(prints).filter(~F.col("discarded")).filter(verified).select("a", "b").distinct()


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A text without words has fingerprint zero and links like any other; null texts count as empty. Documents with equal fingerprints
    are linked. Rows that repeat an id each get a row; a component's id is the smallest non-null id in it. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    prints = materialize(simhash_fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = materialize(links(nodes.select("fp")), "simhash-links")
    roots = connected_components(edges)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
