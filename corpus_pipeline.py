"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, segmentation sampling.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns rows of its columns; the last returns the
sampled segmentations. Rows are told apart by id and text, so ids that repeat with another text do no harm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perigraph.llm.common import materialize, small_side, whole_text
from perigraph.llm.exact_dedup import exact_dedup
from perigraph.llm.language_id import keep_identified
from perigraph.llm.mixing import mix_sources
from perigraph.llm.queries import MIX_LEVELS, MIX_WEIGHTS
from perigraph.llm.sentencepiece_lattice import sample_segmentations
from perigraph.llm.shingle_join import similar_components
from perigraph.llm.simhash import simhash_near_dedup


#: Bytes of a row's key in a broadcast table, about.
KEY_BYTES = 96


def row_key() -> Column:
    return F.struct("doc_id", F.xxhash64(whole_text(F.col("text"))).alias("digest"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose key is not in dropped (perigraph_side)."""
    keyed = docs.withColumn("perigraph_key", row_key())
    left = keyed.join(small_side(dropped, KEY_BYTES), F.col("perigraph_key").eqNullSafe(F.col("perigraph_side")), "left_anti")
    return left.select(*docs.columns)


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("doc_id"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is in one language for at least half of its letters; texts without letters go."""
    return keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the row with the largest id; of rows that repeat an id and its text, one."""
    found = materialize(exact_dedup(keyed_texts(docs)).select(F.col("doc_id").alias("perigraph_side"), "kept"), "pipeline-exact")
    left = without(docs, found.filter("not kept").select("perigraph_side"))
    again = materialize(found.filter("kept").groupBy("perigraph_side").count().filter("count > 1").select("perigraph_side"), "pipeline-repeated")
    if again.isEmpty():
        return left
    keyed = left.withColumn("perigraph_key", row_key())
    repeated = keyed.join(small_side(again, KEY_BYTES), F.col("perigraph_key").eqNullSafe(F.col("perigraph_side")), "left_semi").dropDuplicates(["perigraph_key"])
    return without(left, again).unionByName(repeated.select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    found = simhash_near_dedup(keyed_texts(docs))
    dropped = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("perigraph_side"))
    return without(docs, materialize(dropped, "pipeline-near"))


def similar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by five-word shingles that agree to 0.8, which 3 of 64 bits cannot see."""
    found = similar_components(keyed_texts(docs))
    dropped = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("perigraph_side"))
    return without(docs, materialize(dropped, "pipeline-similar"))


def near_and_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups first, then what is left by exact shingle similarity."""
    return similar_documents(spark, materialize(near_duplicates(spark, docs, sf_dir), "pipeline-simhash"), sf_dir)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps three quarters of all tokens, by the weights of domains, languages and sources; no document twice."""
    keyed = docs.withColumn("perigraph_key", row_key())
    chosen = mix_sources(keyed, MIX_LEVELS, MIX_WEIGHTS, (3, 4), 1, seed=7, id_col="perigraph_key").select(F.col("doc_id").alias("perigraph_side")).distinct()
    chosen = small_side(materialize(chosen, "pipeline-chosen"), KEY_BYTES)
    return keyed.join(chosen, F.col("perigraph_key").eqNullSafe(F.col("perigraph_side")), "left_semi").select(*docs.columns)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text, with their ids as packed 32-bit numbers. Workers are kept small, as the executor's
    heap has grown by the stages before."""
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), seed=11, packed_ids=True, chunk_bytes=1 << 17, kept_edges=400_000)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_and_similar),
    ("mix_sources", mixture),
    ("sentencepiece_sampling", segmentations),
]

#: The last stage draws from counters and vocabularies that SQL cannot express; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
