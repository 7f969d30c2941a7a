"""Substring deduplication with a sharded count-min prefilter.

Documents are dealt to blocks by a hash of their id, once, into a table bucketed by block. A first pass turns each block's
windows of words into cells of a count-min sketch of two rows; a shard, a range of one row's cells, merges the sparse
partial sketches of all blocks and answers every block which of its cells were counted more than once. Estimates never
fall short, so a window whose cells were both counted more than once may be repeated, and any other is not.

A second pass groups these windows exactly, by their words. Neighbouring windows that share their least run of four words
travel as one passage to the shard of that run, so each word is sent about once and equal windows still meet. A shard
compares the words of windows, not hashes, and answers the smallest document of each.

Blocks and shards are sized from the corpus, so what one task holds stays bounded at every size. A window that stands in
a third of all documents counts once per block.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, text_pieces, utf8

WINDOW = 13
#: Words whose least run within a window decides its shard.
RUN = 4
#: Characters of text in a block, about, and buckets of the table of blocks at most.
BLOCK_CHARS, BUCKETS = 8 << 20, 1 << 16
#: Bytes of text that are hashed at once.
HASH_BYTES = 1 << 20
#: Cells of a sketch row for each character of the corpus, about eight for each window.
CELLS_PER_CHAR = 1.5
ROWS, SHARD_BITS = 2, 24

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs_of(words: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """A hash of each size neighbouring values, put together from those of 1, 2, 4, ... of them."""
    done, out, width, doubled = 0, None, 1, words
    while done < size:
        if size & width:
            part = doubled[done : done + max(0, len(words) - size + 1)]
            out = part if out is None else mix(out * odd + part)
            done += width
        if done < size:
            doubled = mix(doubled[:-width] * odd + doubled[width:]) if len(doubled) > width else doubled[:0]
            width *= 2
    return out


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each size neighbouring values."""
    width, out = 1, values
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(values) - size + 1], out[size - width :]) if width < size else out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each word its place in a list of distinct words, by their bytes."""
    sizes = ends - starts
    flat = data[np.arange(int(sizes.sum())) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


class Windows:
    """The words of some texts, two 64-bit hashes of each window of words within one text, and its least run of words."""

    def __init__(self, column: pa.ChunkedArray):
        texts = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        self.data, offsets = utf8(texts)
        parts, at, words = [], 0, 0
        while at < len(offsets) - 1:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASH_BYTES, "right")) - 1)
            part = window_part(self.data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            parts.append([part[0] + offsets[at], part[1] + offsets[at], part[2], part[3] + words, part[4] + at, *part[5:]])
            at, words = end, words + len(part[0])
        kinds = [np.int64] * 5 + [np.uint64] * 3
        joined = [np.concatenate([np.zeros(0, k), *[x[i] for x in parts]]).astype(k) for i, k in enumerate(kinds)]
        self.starts, self.ends, counts, self.at, self.owner, *self.hashes, self.run = joined  # at: first word of a window; owner: its text
        self.bounds = np.append(0, np.cumsum(counts))  # words of text i: bounds[i] to bounds[i + 1]

    def cells(self, bits: int) -> list[np.ndarray]:
        return [h >> np.uint64(64 - bits) for h in self.hashes]

    def passages(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of the chosen windows (sorted): first and end places in chosen of runs of neighbours with one least run, and
        the words of each, joined by one space."""
        if not len(chosen):
            return chosen, chosen, []
        new = np.append(True, (np.diff(chosen) != 1) | (np.diff(self.owner[chosen]) != 0) | (self.run[chosen[1:]] != self.run[chosen[:-1]]))
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(chosen))
        sizes = self.ends - self.starts
        spaced = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        inside = np.arange(int(sizes.sum()))
        spaced[inside + np.repeat(np.arange(len(sizes)), sizes)] = self.data[inside + np.repeat(self.starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)]
        places, held = np.append(0, np.cumsum(sizes + 1)), spaced.tobytes()
        begin, stop = places[self.at[chosen[first]]], places[self.at[chosen[end - 1]] + WINDOW] - 1
        return first, end, [held[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]


def window_part(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Starts and ends of words, words per text, first words and texts of windows, the windows' two hashes and least runs."""
    space, edge = SPACE[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (edge[:-1] | np.append(True, space[:-1]))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & (edge[1:] | np.append(space[1:], True))) + 1 if len(data) else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, offsets))
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(owner) < WINDOW:
        return [starts, ends, counts, *[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.uint64)] * 3]
    at = np.flatnonzero(owner[WINDOW - 1 :] == owner[: len(owner) - WINDOW + 1])
    which, distinct = distinct_words(data, starts, ends)
    words = np.array([xxhash.xxh3_64_intdigest(x) for x in distinct.to_pylist()], np.uint64)[which]
    least = least_of(runs_of(words, RUN, ODD[0]), WINDOW - RUN + 1)
    return [starts, ends, counts, at, owner[at], *[runs_of(words, WINDOW, odd)[at] for odd in ODD], least[at]]


def planes(values: np.ndarray) -> bytes:
    """Sorted uint32 values as byte planes of their differences, which the shuffle's compression packs well."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def split_shards(cells: np.ndarray, low: int) -> list[tuple[int, slice]]:
    """Runs of sorted cells that share the bits above low."""
    if not len(cells):
        return []
    shard = (cells >> np.uint64(low)).astype(np.int64)
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return [(int(shard[a]), slice(a, b)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True)]


def window_groups(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows that begin at these words, equal ones together, and where in it each group begins.

    Windows are brought together by hashes and told apart by their words.
    """
    hashes = runs_of(mix(words.astype(np.uint64) + np.uint64(1)), WINDOW, ODD[0])[at]
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, np.diff(hashes[order]) != 0)
    leader = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    if any((words[at[order] + k] != words[at[leader] + k]).any() for k in range(WINDOW)):
        order = np.lexsort([words[at + k] for k in range(WINDOW)])
        new = np.append(True, np.any([np.diff(words[at[order] + k]) != 0 for k in range(WINDOW)], axis=0))
    return order, np.flatnonzero(new)


def least_documents(passages: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each of some passages (words joined by one space) with its document: the smallest document of each window."""
    data = np.frombuffer(b"\n".join([*passages, b""]), np.uint8)
    gaps = np.flatnonzero((data == 32) | (data == 10))
    words, _ = distinct_words(data, np.append(0, gaps[:-1] + 1), gaps)
    ends = np.flatnonzero(data[gaps] == 10) + 1
    counts = np.diff(ends, prepend=0) - WINDOW + 1  # windows of each passage
    cuts = np.append(0, np.cumsum(counts))
    at = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - (ends - counts - WINDOW + 1), counts)
    order, first = window_groups(words, at)
    smallest = np.empty(len(at), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(np.repeat(ids, counts)[order], first), np.diff(np.append(first, len(order))))
    return np.split(smallest, cuts[1:-1])


def bucketed(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """df written once to the shared folder, dealt by the column, so that grouping by it later moves nothing."""
    spark, name = df.sparkSession, f"perigraph_blocks_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, column)
    dealt.write.bucketBy(buckets, column).sortBy(column).option("path", fresh_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    A word goes if it lies in a window of 13 words that also starts in a document with a smaller id. Windows are judged
    on the input. Null texts and those without words give no word and the digest of the empty string; texts of under 13
    words keep all. Rows that repeat an id are one document when windows are judged and keep a row each; a null id is
    smaller than any other. Ids must be whole numbers. An empty table gives an empty result; other columns are ignored,
    whatever their names. The texts dealt to blocks are kept as a table of the session's catalog, in the shared folder.
    """
    texts = text_pieces(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    bits = max(SHARD_BITS, math.ceil(math.log2(max(2, chars * CELLS_PER_CHAR))))
    low = SHARD_BITS
    shards = 1 << (bits - low)
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)).cast("int")
    grouped = bucketed(texts.select(block.alias("block"), "doc_id", "text"), min(blocks, BUCKETS), "block").groupBy("block")

    def own_block(table: pa.Table) -> int:
        return table.column("block")[0].as_py() if table.num_rows else 0

    def doc_ids(table: pa.Table) -> np.ndarray:
        return np.array([np.iinfo(np.int64).min if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)

    def sketch(table: pa.Table) -> pa.Table:
        """The block's part of each shard: its sorted distinct cells, and which of them it counts more than once."""
        found, out = Windows(table.column("text")), []
        for row, cells in enumerate(found.cells(bits)):
            cells = np.sort(cells)
            new = np.append(True, cells[1:] != cells[:-1]) if len(cells) else np.zeros(0, bool)
            distinct, more = cells[new], np.append(~new[1:], False)[new] if len(cells) else new
            for shard, own in split_shards(distinct, low):
                out.append((row * shards + shard, planes((distinct[own] & np.uint64((1 << low) - 1)).astype(np.uint32)), np.packbits(more[own]).tobytes()))
        return pa.table({"shard": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([own_block(table)] * len(out), pa.int32()), "cells": pa.array([x[1] for x in out], pa.binary()), "more": pa.array([x[2] for x in out], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        """Adds the partial sketches of a shard and marks, for each block, its cells that were counted more than once."""
        counts = np.zeros(1 << low, np.uint8)
        parts = [from_planes(x) for x in table.column("cells").to_pylist()]
        for cells, more in zip(parts, table.column("more").to_pylist(), strict=True):
            own = counts[cells]
            own += 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(cells))
            counts[cells] = np.minimum(own, 2)
        marks = [np.packbits(counts[cells] > 1).tobytes() for cells in parts]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "answer": pa.array(marks, pa.binary())})

    def suspects(found: Windows, held: dict[int, bytes]) -> np.ndarray:
        """The windows whose cells were counted more than once in both rows of the sketch."""
        keep = np.ones(len(found.at), bool)
        for row, cells in enumerate(found.cells(bits)):
            order = np.argsort(cells)
            ordered = cells[order]
            new = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
            distinct, marked = ordered[new], np.zeros(int(new.sum()), bool)
            for shard, own in split_shards(distinct, low):
                marked[own] = np.unpackbits(np.frombuffer(held[row * shards + shard], np.uint8), count=own.stop - own.start).astype(bool)
            keep[order] &= marked[np.cumsum(new) - 1]
        return np.flatnonzero(keep)

    def shard_of(found: Windows, windows: np.ndarray) -> list[int]:
        return (mix(found.run[windows]) >> np.uint64(63 - (bits - low)) >> np.uint64(1)).astype(np.int64).tolist()

    def exact_parts(table: pa.Table, marks: pa.Table) -> pa.Table:
        """The block's distinct passages of suspected windows, in order, with the smallest document that has each."""
        held: dict[int, dict[bytes, int]] = {}
        if table.num_rows:
            found, ids = Windows(table.column("text")), doc_ids(table)
            chosen = suspects(found, dict(zip(marks.column("shard").to_pylist(), marks.column("answer").to_pylist(), strict=True)))
            first, _, words = found.passages(chosen)
            for shard, passage, own in zip(shard_of(found, chosen[first]), words, ids[found.owner[chosen[first]]].tolist(), strict=True):
                seen = held.setdefault(shard, {})
                if seen.get(passage, own) >= own:
                    seen[passage] = own
        rows = [(shard, *zip(*sorted(seen.items()), strict=True)) for shard, seen in held.items()]
        return pa.table({"shard": pa.array([x[0] for x in rows], pa.int64()), "block": pa.array([own_block(table)] * len(rows), pa.int32()), "passages": pa.array([b"\n".join(x[1]) for x in rows], pa.binary()), "ids": pa.array([np.array(x[2], np.int64).tobytes() for x in rows], pa.binary())})

    def least(table: pa.Table) -> pa.Table:
        """The smallest document of each window of a shard's passages, for every block in the order of its passages."""
        parts = [x.split(b"\n") for x in table.column("passages").to_pylist()]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        found = least_documents([x for part in parts for x in part], ids)
        cuts = np.append(0, np.cumsum([len(x) for x in parts]))
        answers = [np.concatenate(found[a:b]).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.table({"block": table.column("block"), "shard": pa.array([-1 - x for x in table.column("shard").to_pylist()], pa.int64()), "answer": pa.array(answers, pa.binary())})

    def gone_words(found: Windows, ids: np.ndarray, held: dict[int, bytes]) -> np.ndarray:
        """Which words lie in a window that starts in a smaller document, by the answers (of shard n at -1 - n)."""
        chosen = suspects(found, held)
        first, end, words = found.passages(chosen)
        gone = np.zeros(len(found.starts) + 1, np.int64)
        if len(chosen):
            of_shard: dict[int, set[bytes]] = {}
            shards_of_passages = shard_of(found, chosen[first])
            for shard, passage in zip(shards_of_passages, words, strict=True):
                of_shard.setdefault(shard, set()).add(passage)
            answers, place, upto = [], {}, 0
            for shard, own in of_shard.items():
                answers.append(np.frombuffer(held[-1 - shard], np.int64))
                for passage in sorted(own):
                    place[passage] = upto
                    upto += passage.count(b" ") + 2 - WINDOW
            smallest = np.concatenate(answers)
            start = np.array([place[x] for x in words])
            index = np.arange(len(chosen)) + np.repeat(start - first, end - first)
            hit = found.at[chosen[smallest[index] < ids[found.owner[chosen]]]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + WINDOW, -1)
        return np.cumsum(gone[:-1]) > 0

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        found, ids = Windows(table.column("text")), doc_ids(table)
        removed = gone_words(found, ids, dict(zip(answers.column("shard").to_pylist(), answers.column("answer").to_pylist(), strict=True)))
        data, names, out = found.data.tobytes(), table.column("doc_id").to_pylist(), []
        for i, doc_id in enumerate(names):
            a, b = found.bounds[i], found.bounds[i + 1]
            keep = np.flatnonzero(~removed[a:b]) + a
            kept = b" ".join([data[x:y] for x, y in zip(found.starts[keep].tolist(), found.ends[keep].tolist(), strict=True)])
            out.append((doc_id, int(b - a), int(b - a - len(keep)), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
        return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(kinds.items())})

    sketched = grouped.applyInArrow(sketch, "shard long, block int, cells binary, more binary")
    marks = materialize(sketched.groupBy("shard").applyInArrow(merge, "block int, shard long, answer binary"), "window-marks")
    parts = grouped.cogroup(marks.groupBy("block")).applyInArrow(exact_parts, "shard long, block int, passages binary, ids binary")
    answers = parts.groupBy("shard").applyInArrow(least, "block int, shard long, answer binary")
    out = grouped.cogroup(marks.unionByName(answers).groupBy("block")).applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
