"""Document fingerprints by Order MinHash.

For each of several hash functions, the few smallest occurrence-numbered k-mers of a text are selected, put back into
text order, and their tuple is hashed. As the order of the selected k-mers counts, the share of equal tuples follows
edit distance, not only shared content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_pieces

KMER, TUPLE, FUNCTIONS = 6, 2, 32
#: Positions that are hashed by all functions at once.
TILE = 1 << 12
MULTIPLIERS = np.array([int.from_bytes(hashlib.sha256(f"order minhash {i}".encode()).digest()[:8], "little") | 1 for i in range(FUNCTIONS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def kmer_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the k-mer at each position; a shorter text is one k-mer, an empty one none."""
    k = min(KMER, len(points))
    n = len(points) - k + 1 if k else 0
    wide, total = points.astype(np.uint64), np.full(n, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + wide[j : j + n]
    return mix(total)


def numbered(kmers: np.ndarray) -> np.ndarray:
    """The k-mer hashes, those of repeated k-mers mixed with their occurrence number."""
    ordered = np.sort(kmers)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return kmers
    at = np.searchsorted(again, kmers)
    at[at == len(again)] = 0
    places = np.flatnonzero(again[at] == kmers)
    group = at[places]
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(group[order]) > 0))
    number = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    out = kmers.copy()
    out[places[order]] = mix(kmers[places[order]] + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def order_minhash(text: str) -> np.ndarray:
    """FUNCTIONS 32-bit coordinates."""
    kmers = kmer_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    values, found = numbered(kmers), []
    for start in range(0, len(values), TILE):
        tile = MULTIPLIERS[:, None] * values[None, start : start + TILE]
        for _ in range(min(TUPLE, tile.shape[1])):
            best = tile.argmin(axis=1)
            found.append((np.take_along_axis(tile, best[:, None], 1)[:, 0], best + start))
            np.put_along_axis(tile, best[:, None], np.uint64(0xFFFFFFFFFFFFFFFF), 1)
    coordinates = mix(MULTIPLIERS)
    if found:
        least, places = (np.stack(x, 1) for x in zip(*found, strict=True))
        chosen = np.argsort(least, axis=1, kind="stable")[:, :TUPLE]
        places = np.sort(np.take_along_axis(places, chosen, 1), axis=1)
        for j in range(places.shape[1]):
            coordinates = mix(coordinates * np.uint64(31) + kmers[places[:, j]])
    return (coordinates >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def to_hex(coordinates: np.ndarray) -> str:
    return coordinates.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text, its last quarter (rounded down) replaced by as many first code points of the following one, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def described(text: str, own: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else order_minhash(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(own), to_hex(other), likeness(own, other), likeness(own, next_print)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next id, after the last the first; ids that repeat are ordered by text, a null id
    comes first. Null texts count as empty. Equal texts have equal fingerprints, empty ones too; a text shorter than a
    k-mer is one k-mer. A single document is followed by itself. An empty table gives an empty result; other columns are
    ignored, whatever their names. Documents are dealt to ranges of ids and stream through them with one document of
    look-ahead; only the first and last of each range meet again in a second, small step.
    """
    texts = text_pieces(docs, id_col, text_col)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[x.split()[0] for x in COLUMNS.split(", ")], "range", "head", "tail"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        ids, out, held, head = None, [], None, None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in out], ids), *[pa.array([r[i + 1] for r in out], k) for i, k in enumerate(kinds)]]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in rows:
            ids = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held[2] if held and held[1] == text else order_minhash(text)
                if held:
                    out.append((held[0], *described(held[1], held[2], text, own), place, head, None))
                head = text if held is None else None
                held = (doc_id, text, own)
            if out:
                yield flush()
        if held:
            out.append((held[0], len(held[1]), None, to_hex(held[2]), None, None, None, place, head, held[1]))
            yield flush()

    ranged = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = materialize(ranged.mapInArrow(run, f"doc_id {id_type}, {COLUMNS}, range int, head string, tail string"), "order-minhash")

    # One head and one tail per range that has rows.
    heads = done.filter("head is not null").select("range", F.col("head").alias("following"), F.col("fingerprint").alias("next_print"))
    order = Window.orderBy("range")
    after = done.filter("tail is not null").select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(order)).alias("next_range"))
    tails = done.filter("tail is not null").select("doc_id", "tail", "fingerprint", "range").join(after, "range")
    tails = tails.join(heads.withColumnRenamed("range", "next_range"), "next_range").select("doc_id", "tail", "fingerprint", "following", "next_print")

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in rows:
            out = []
            for row in batch.select(["tail", "fingerprint", "following", "next_print"]).to_pylist():
                own, after_it = (np.frombuffer(bytes.fromhex(row[k]), ">u4").astype(np.uint32) for k in ("fingerprint", "next_print"))
                out.append(described(row["tail"], own, row["following"], after_it))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], names=names[:7])

    finished = tails.mapInArrow(finish, f"doc_id {id_type}, {COLUMNS}")
    return done.filter("tail is null").select(*finished.columns).unionByName(finished)
