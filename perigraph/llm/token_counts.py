"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer version digest, count). Documents are joined to it by
digest; contents that it lacks are encoded and appended once. Texts are encoded where they are read, unless the cache holds
over a quarter of very many.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, sliced, small_side, text_pieces

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: Bytes of text that one call of the tokenizer gets.
ENCODE_BYTES = 1 << 20
#: Bytes of a digest and its count or id in a broadcast table, as measured.
ROW_BYTES = 160
#: Misses among all documents from which every text is encoded in place, and digests by which a task knows copies.
MOSTLY, SEEN = 0.75, 100_000


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file, the library and the options that decide a count."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + library.encode() + b"|no special tokens added, no truncation, no padding").hexdigest()


def counter(path: str):
    """Counts tokens of a list of texts: sentencepiece for .model, else tokenizers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """The cache's counts for one tokenizer version, one row per digest; empty if there is no cache yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return cache.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. Appends what the cache lacks to cache_path.

    A null text counts as empty (0 bytes, 0 tokens). Normalisation of the content is only that of nulls, as any other
    could change a count. Documents that repeat an id or a text each get a row. An empty table gives an empty result; other
    columns are ignored, whatever their names. A text that the cache lacks is encoded once; where most texts are such and
    too many to broadcast, once in each task that reads it.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    texts = text_pieces(docs, id_col, text_col)
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    digests = texts.select("doc_id", digest, F.octet_length("text").cast("long").alias("n_bytes"))
    # Equal digests combine before they are shuffled, so a content with many copies is no hot key of the join.
    misses = digests.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(read_cache(spark, cache_path, version), "digest", "left_anti")
    misses = materialize(misses, "token-misses")

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(tokenizer), set()
        for batch in rows:
            batch = batch.filter(pa.array([not (d in seen or seen.add(d)) for d in batch.column(0).to_pylist()], pa.bool_()))
            if len(seen) > SEEN:
                seen.clear()
            for part in sliced(batch, 1, ENCODE_BYTES) if batch.num_rows else ():
                counts = pa.array(count(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * len(counts)), counts], names=["digest", "version", "n_tokens"])

    missing = misses.count()
    if missing * ROW_BYTES > BROADCAST_BYTES and missing >= MOSTLY * texts.count():
        # Nearly all texts would be moved to be fetched: they stay, at the cost of copies that other tasks encode too.
        encoded = texts.select(digest, "text").mapInArrow(encode, CACHE_SCHEMA).join(misses, "digest", "left_semi")
    else:
        # A miss is fetched by its id and checked by its digest, as ids may repeat with other texts. Few misses go to the
        # texts, which then stay where they are.
        chosen = misses.withColumnsRenamed({"digest": "wanted", "doc_id": "wanted_id"})
        chosen = F.broadcast(chosen) if missing * ROW_BYTES <= BROADCAST_BYTES else chosen
        fetched = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).filter(F.unhex(F.sha2("text", 256)) == F.col("wanted"))
        encoded = fetched.select(F.col("wanted").alias("digest"), "text").mapInArrow(encode, CACHE_SCHEMA)
    encoded.dropDuplicates(["digest"]).write.mode("append").parquet(cache_path)
    # Written once more, so that the join's sides are plain exchanges, whose hot digests adaptive execution can split.
    counts = materialize(read_cache(spark, cache_path, version), "token-counts")
    counted = digests.join(small_side(counts, ROW_BYTES), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
