"""All links between texts whose sets of word shingles agree to a given Jaccard similarity, by an exact prefix join.

Shingles are ordered by how full their bucket of a fixed table is, rare ones first, then by hash. Two sets that agree to
the share s have a shingle in common among the first n - ceil(s n) + 1 of each (prefix filter), have sizes within s of
each other (length filter), and enough shingles left at the first that they share (positional filter). Sketches, counts
of a set's shingles in ranges of their hashes, bound from above what two sets can share and discard most of what is left.
The rest is verified by the whole sets, which are made again from the texts of these documents only. Any order loses no
pair; the table only keeps common shingles out of the prefixes.

A shingle with many holders gives no pairs. Its holders are dealt to blocks of bounded rows and bytes, and each two blocks
count shared shingles by one matrix product and give only links that join groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, small_side, text_pieces, utf8
from .components import connected_components
from .simhash import shingle_hashes

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BUCKET_BITS, SKETCH_BITS = 17, 8
#: Holders of a shingle that are paired; more are compared in blocks.
PAIRED = 64
#: Bytes of a shared shingle and its number of holders. The bound of a broadcast is then 1.26 million of them, for which
#: Spark's table was measured to take 134 MB; more are joined by a shuffle.
SHARED_BYTES = 20
#: Rows and bytes of shingles in a block of holders, about; two blocks meet in a task.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
#: Cells of a matrix of rows and shingles that is multiplied at once.
CELLS = 1 << 22


def at_least(similarity: float, n: int) -> int:
    return max(1, math.ceil(similarity * n - 1e-9))


def sets_of(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text (second column)."""
    data, offsets = utf8(batch.column(1))
    data = data.tobytes()
    return [np.unique(np.array(shingle_hashes(data[a:b], words), np.uint64)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def node_of(shingles: np.ndarray) -> int:
    """A set's name: a signed hash of its shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def buckets(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def bucket_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of the sets are in each of 2^BUCKET_BITS buckets; one row per bucket returns."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in rows:
            counts += np.bincount(buckets(np.concatenate([np.zeros(0, np.uint64), *sets_of(batch, words)]), BUCKET_BITS), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "n"])

    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def summaries(texts: DataFrame, counts: np.ndarray, words: int, similarity: float) -> DataFrame:
    """doc_id, node, n (size of the set), sketch and prefix of every text with a word."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, most = shared.value, np.iinfo(np.uint8).max
        for batch in rows:
            out = []
            for own in sets_of(batch, words):
                keep = len(own) - at_least(similarity, len(own)) + 1 if len(own) else 0
                sketch = np.minimum(np.bincount(buckets(own, SKETCH_BITS), minlength=1 << SKETCH_BITS), most).astype(np.uint8)
                out.append((node_of(own), len(own), sketch.tobytes(), own[np.lexsort((own, table[buckets(own, BUCKET_BITS)]))[:keep]].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "node", "n", "sketch", "prefix"])
        release_memory()

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, node long, n int, sketch binary, prefix binary").filter("n > 0")


def prefix_rows(held: DataFrame) -> DataFrame:
    """shingle, node, n and place for the prefix of each set."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in own], np.int64)
            places = np.arange(int(sizes.sum())) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
            columns = [np.concatenate([np.zeros(0, np.int64), *own]), *[np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1)], places.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "n", "place"])

    return held.select("node", "n", "prefix").mapInArrow(run, "shingle long, node long, n int, place int")


def may_agree(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches leave room for the similarity. A full cell tells nothing and passes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 1 << SKETCH_BITS) for i in (2, 3))
            sizes = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
            shared = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            full = (x == 255).any(axis=1) | (y == 255).any(axis=1)
            yield batch.select([0, 1]).filter(pa.array(full | (shared >= similarity * (sizes - shared) - 1e-9)))

    one, two = (held.select(F.col("node").alias(c), F.col("sketch").alias(s), F.col("n").alias(n)) for c, s, n in (("a", "x", "p"), ("b", "y", "q")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "p", "q").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets agree to the similarity."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_rows(sets: list[bytes], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) between rows of left and right whose sets agree to the similarity, enough to join what all of them join."""
    flat = np.frombuffer(b"".join(sets), np.uint64)
    sizes = np.array([len(x) // 8 for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1  # a shingle of one row is shared with none
    keep = times[column] > 1
    owner, column, width = owner[keep], new[column[keep]], int((times > 1).sum())
    shared = np.zeros((len(left), len(right)), np.float32)
    step = max(1, CELLS // max(1, len(sets)))
    for start in range(0, width, step):
        part = (column >= start) & (column < start + step)
        held = np.zeros((len(sets), min(step, width - start)), np.float32)
        held[owner[part], column[part] - start] = 1.0
        shared += held[left] @ held[right].T
    enough = shared >= similarity * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-9
    group, out = list(range(len(sets))), []

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for row, i in zip(enough, left.tolist(), strict=True):
        for j in right[np.flatnonzero(row)].tolist():
            x, y = find(i), find(j)
            if x != y:
                group[x] = y
                out.append((i, j))
    return out


def crowds(holders: DataFrame) -> DataFrame:
    """shingle, low, high, own and node: holders (shingle, node, n) dealt to blocks, each two blocks of a shingle together.

    Shingles with the same holders are taken once.
    """
    per_shingle = holders.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("bits"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("more"),
    )
    chosen = per_shingle.groupBy("rows", "sum", "bits", "more").agg(F.min(F.struct("shingle", "total")).alias("k"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("k.total") * 8 / BLOCK_BYTES)).cast("int")
    dealt = holders.join(small_side(materialize(chosen.select("k.shingle", blocks.alias("blocks")), "shingle-crowds"), 32), "shingle")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node")


def links_in_crowds(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def compare(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        own, nodes = table.column("own").to_numpy(), table.column("node").to_numpy()
        found = similar_rows(table.column("shingles").to_pylist(), np.flatnonzero(own == low), np.flatnonzero(own == high), similarity)
        return pa.table({"a": pa.array(nodes[[i for i, _ in found]] if found else [], pa.int64()), "b": pa.array(nodes[[j for _, j in found]] if found else [], pa.int64())})

    return dealt.join(sets, "node").groupBy("shingle", "low", "high").applyInArrow(compare, "a long, b long")


def similar_components(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of each document in a component of several, the smallest id in it.

    Documents are linked if their sets of word shingles, by 64-bit hashes, have at least the Jaccard similarity. Texts
    without words link with nothing; a text shorter than a shingle is one shingle. Null texts count as empty. Rows that
    repeat an id each get a row. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    texts = text_pieces(docs, id_col, text_col)
    held = materialize(summaries(texts, bucket_counts(texts, words), words, similarity), "shingle-summaries")
    rows = prefix_rows(held)
    shared = materialize(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1"), "shingle-shared")
    met = materialize(rows.join(small_side(shared, SHARED_BYTES), "shingle").distinct(), "shingle-holders")  # equal sets once

    few, two = (met.filter(F.col("holders") <= PAIRED).alias(x) for x in ("a", "b"))
    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    near = (left >= (F.col("a.n") + F.col("b.n")) * (similarity / (1 + similarity)) - 1e-6) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * similarity - 1e-6)
    pairs = few.join(two, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.node") < F.col("b.node")) & near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    sketches = held.select("node", "n", "sketch").join(small_side(materialize(met.select("node").distinct(), "shingle-nodes"), 24), "node", "left_semi").dropDuplicates(["node"])
    pairs = materialize(may_agree(pairs, sketches, similarity), "shingle-pairs")
    dealt = crowds(met.filter(F.col("holders") > PAIRED))

    # Whole sets of the nodes left, made again from the texts.
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(dealt.select("node")).distinct()
    needed = held.join(small_side(materialize(needed, "shingle-needed"), 24), "node", "left_semi").select(F.col("doc_id").alias("own_id"))
    wanted = texts.join(small_side(materialize(needed.distinct(), "shingle-documents"), 64), F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi")

    def whole(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = sets_of(batch, words)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "shingles"])

    sets = materialize(wanted.mapInArrow(whole, "node long, shingles binary").dropDuplicates(["node"]), "shingle-sets")
    edges = verified(pairs, sets, similarity).unionByName(links_in_crowds(dealt, sets, similarity))
    rooted = held.select("doc_id", "node").join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    table = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rooted.join(table, "root").select("doc_id", "component_id")
