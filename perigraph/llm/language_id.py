"""Language identification: script ranges, word scores, and Viterbi spans.

The script of a word narrows the languages that it can be in to those whose training text uses that script. Each word is
scored by the log probabilities of its letter trigrams and four-grams in each language; Viterbi over the words of a
text, with a penalty for each switch, labels spans. The prediction is the language of most letters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import bound_batches, release_memory, sliced, whole_text

# First code point of each range of the Unicode blocks that name a script, and its end.
SCRIPTS = [
    ("latin", 0x0041, 0x02AF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(x[0] for x in SCRIPTS)]
UNKNOWN = "und"

GRAM_BITS = 16
#: Training texts per language, about: they bound the sample; the model grows with the languages, at half a MB each.
TRAIN_DOCS = 1500
#: A language can be written in a script if so large a share of its training letters is.
SCRIPT_SHARE = 0.001
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
#: Bytes of text that are labelled together.
CHUNK_BYTES = 1 << 19


@lru_cache(1)
def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, its lower-case form, its script."""
    n = sys.maxunicode + 1
    letters = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(letters).tolist():
        small = chr(i).lower()
        if len(small) == 1:
            lower[i] = ord(small)
    scripts = np.zeros(n, np.uint8)
    for name, first, last in SCRIPTS:
        scripts[first : last + 1] = SCRIPT_NAMES.index(name)
    return letters, lower, scripts


class Words:
    """The words (runs of letters) of several texts, with the grams of each."""

    def __init__(self, texts: list[str]):
        is_letter, lower, script = letter_tables()
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = is_letter[points]
        folded = np.where(letter, lower[points], 0).astype(np.uint64)
        starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.starts, ends = starts, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        self.letters = ends - starts
        self.text_starts = np.cumsum([1, *[len(x) + 1 for x in texts]])
        self.bounds = np.searchsorted(starts, self.text_starts)
        self.script = script[points[starts]]
        self.script_counts = (script, points, letter)
        # One gram of each order ends at every letter and at the end of a word; zeros stand before its first letter.
        at = np.flatnonzero(letter | np.append(False, letter[:-1]))
        valid, mixed, self.grams = np.ones(len(at), bool), folded[at], []
        for k in (1, 2, 3):
            before = np.maximum(at - k, 0)
            valid = valid & letter[before]
            mixed = (mixed * np.uint64(0x100000001B3) + np.where(valid, folded[before], 0) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            if k > 1:
                self.grams.append((mixed >> np.uint64(64 - GRAM_BITS)).astype(np.int64) + ((k - 2) << GRAM_BITS))
        self.first = np.searchsorted(at, starts)

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Sum of the grams' rows of the table for each word."""
        rows = table[self.grams[0]]
        rows += table[self.grams[1]]
        return np.add.reduceat(rows, self.first, axis=0) if len(self.first) else rows[:0]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, gram log probabilities, and which script each can be in, of docs (id, text, lang) without null lang.

    From every language about TRAIN_DOCS texts are drawn by a hash of the id, so the model gathers a bounded amount at
    every size of the corpus.
    """
    counts = docs.groupBy("lang").count().collect()  # a row per language
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return [], np.zeros((2 << GRAM_BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, TRAIN_DOCS / r["count"]))])
    draw = (F.xxhash64("id", F.lit("train")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < F.try_element_at(rate, F.col("lang"))
    size, number = (2 << GRAM_BITS) + len(SCRIPT_NAMES), {x: i for i, x in enumerate(langs)}

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), size), np.int64)
        for batch in rows:
            for part in sliced(batch, 0, CHUNK_BYTES):
                own = np.array([number[x] for x in part.column(1).to_pylist()])
                words = Words(part.column(0).to_pylist())
                script, points, letter = words.script_counts
                for i, lang in enumerate(own):
                    a, b = words.text_starts[i], words.text_starts[i + 1]
                    total[lang, 2 << GRAM_BITS :] += np.bincount(script[points[a:b][letter[a:b]]], minlength=len(SCRIPT_NAMES))
                lang_of_word = np.repeat(own, np.diff(words.bounds))
                sizes = np.diff(np.append(words.first, len(words.grams[0])))
                lang_of_gram = np.repeat(lang_of_word, sizes)
                for grams in words.grams:
                    np.add.at(total.reshape(-1), lang_of_gram * size + grams, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(langs))), pa.array([x.tobytes() for x in total], pa.binary())], names=["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    sample = docs.filter(draw).select("text", "lang").repartition(8)  # bounded, so a few partitions hold it
    added = sample.mapInArrow(count, "lang long, counts binary").groupBy("lang").applyInArrow(add, "lang long, counts binary").collect()
    total = np.zeros((len(langs), size))
    for r in added:
        total[r["lang"]] = np.frombuffer(r["counts"], np.int64)
    table = np.zeros((2 << GRAM_BITS, len(langs)), np.float32)
    for order in (0, 1):
        own = slice(order << GRAM_BITS, (order + 1) << GRAM_BITS)
        seen = total[:, own] + SMOOTHING
        table[own] = np.log(seen / seen.sum(axis=1, keepdims=True)).T
    scripts = total[:, 2 << GRAM_BITS :]
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    return langs, table, allowed


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of each word: all texts step forward together, longest first, so that a step is one operation."""
    counts = np.diff(bounds)
    order = np.argsort(-counts, kind="stable")
    counts, starts = counts[order], bounds[:-1][order]
    path = np.zeros(len(scores), np.int64)
    steps = int(counts[0]) if len(counts) else 0
    if steps == 0:
        return path
    active = np.searchsorted(-counts, -np.arange(steps), "left")  # texts with more words than the step
    best, stay = scores[starts[: active[0]]].copy(), np.zeros(scores.shape, bool)
    leader = np.zeros(len(scores), np.int64)
    rows = np.arange(len(counts))
    leader[starts[: active[0]]] = best.argmax(axis=1)
    for t in range(1, steps):
        n = active[t]
        at, best = starts[:n] + t, best[:n]
        top = best[rows[:n], leader[at - 1]] - penalty
        kept = best >= top[:, None]
        stay[at] = kept
        best = np.where(kept, best, top[:, None]) + scores[at]
        leader[at] = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n, ends = active[t], active[t + 1] if t + 1 < steps else 0
        at = starts[:n] + t
        now = leader[at]
        if ends:
            after = path[at[:ends] + 1]
            now[:ends] = np.where(stay[at[:ends] + 1, after], after, leader[at[:ends]])
        path[at] = now
    return path


def label_texts(texts: list[str], langs: list[str], table: np.ndarray, allowed: np.ndarray) -> list[tuple]:
    """lang_pred, score and spans of each text."""
    words = Words(texts)
    scores = words.scores(table)
    possible = allowed[words.script]
    scores = np.where(possible | ~possible.any(axis=1, keepdims=True), scores, np.float32(-1e6))
    path = viterbi(scores, words.bounds)
    out = []
    for i in range(len(texts)):
        a, b = words.bounds[i], words.bounds[i + 1]
        if a == b or not langs:
            out.append((UNKNOWN, 0.0, []))
            continue
        own, letters = path[a:b], words.letters[a:b]
        share = np.bincount(own, weights=letters, minlength=len(langs))
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        last = np.append(first[1:], b - a) - 1
        begin = words.starts[a:b] - words.text_starts[i]
        spans = [{"start": int(begin[x]), "end": int(begin[y] + letters[y]), "lang": langs[own[x]]} for x, y in zip(first, last, strict=True)]
        out.append((langs[int(share.argmax())], float(share.max() / letters.sum()), spans))
    return out


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("lang", StringType())]))
LABELS = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", SPANS)]


def label_rows(docs: DataFrame, learn: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Each row of docs as the struct row, with lang_pred, score and spans of its text."""
    labelled = learn.select(F.col(f"`{id_col}`").alias("id"), whole_text(F.col(f"`{text_col}`")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("lang is not null")
    model = docs.sparkSession.sparkContext.broadcast(train(labelled))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))]
        langs, table, allowed = model.value
        for batch in rows:
            texts = pc.fill_null(pc.cast(pc.struct_field(batch.column(0), [at]), pa.string()), "")
            for part in sliced(pa.RecordBatch.from_arrays([batch.column(0), texts], names=["row", "text"]), 1, CHUNK_BYTES):
                columns = zip(*label_texts(part.column(1).to_pylist(), langs, table, allowed), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["row", "lang_pred", "score", "spans"])
        release_memory()

    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return own.mapInArrow(run, StructType([own.schema["row"], *LABELS]))


def identify_languages(docs: DataFrame, learn: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (share of letters), spans (start, end in code points, lang).

    learn holds the texts and labels to learn from (docs if none is given); null labels are left out. Predictions use
    the text alone. A null text or one without a letter gives "und", score 0 and no span, as does everything if there
    is nothing to learn from. Ties go to the language that is first in text order. Rows that repeat an id each get a
    row; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    labelled = docs if learn is None else learn
    labelled = labelled.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    return label_rows(own, labelled, "doc_id", "text", "lang").select("row.doc_id", "lang_pred", "score", "spans")


def keep_identified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose text is in one language for the share min_score of its letters.

    It learns from the labelled rows among docs. Where the label is null, the predicted language takes its place. Texts
    without letters go; if there are no labels to learn from, every row goes.
    """
    kept = label_rows(docs, docs, id_col, text_col, lang_col).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[(F.coalesce(F.col("row")[c], F.col("lang_pred")) if c == lang_col else F.col("row")[c]).alias(c) for c in docs.columns])
