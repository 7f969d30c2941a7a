"""The corpus queries and their SQL, for the repository's query registry."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .language_id import identify_languages
from .license_scan import license_scan
from .merkle import merkle_manifest, proof_digest
from .mixing import mix_sources
from .order_minhash import document_fingerprints
from .sentencepiece_lattice import sample_segmentations
from .simhash import simhash_near_dedup
from .substring_dedup import substring_dedup
from .token_counts import count_tokens
from .whitening import Whitening, whiten


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), with_text=False)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = identify_languages(docs, learn=docs.filter(~held_out()))
    return labels.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


#: Production weights of the mixture; a source's domain is its number modulo 4.
MIX_LEVELS = {"domain": "'domain' || try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4", "lang": "lang", "source": "source"}
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, at most two epochs of any source."""
    return mix_sources(documents(spark, sf_dir), MIX_LEVELS, MIX_WEIGHTS, (1, 2), 2, seed=7)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every run does the whole work."""
    return count_tokens(documents(spark, sf_dir), fresh_path(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of every document, each decoded and held against the text."""
    return sample_segmentations(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), seed=11, packed_ids=True)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("blocks")


def whitened_columns(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each vector and component."""
    shares = F.array(*[F.lit(e).cast("double") for e in (model.explained if model else [])])
    out = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n if model else None).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).cast("double").alias("explained"), F.lit(model.identity_error if model else None).cast("double").alias("identity_error"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_columns(*whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def merkle_of(docs: DataFrame) -> DataFrame:
    """The manifest of documents, a seventh of them seen with another n_chars."""
    altered = {"n_chars": F.col("n_chars").cast("decimal(20, 0)") + 1}
    return merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], altered=altered, alter=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def merkle_columns(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_columns(merkle_of(documents(spark, sf_dir)))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def mix_sql() -> str:
    """The mixture in SQL: one block of waterfilling for each level, then running sums over whole leaves."""
    weight = {k: "CASE " + k + "".join(f" WHEN '{a}' THEN {b}" for a, b in v.items()) + " ELSE 1 END" for k, v in MIX_WEIGHTS.items()}
    levels, blocks = ["domain", "lang", "source"], []
    for depth, level in enumerate(levels):
        parents, own = levels[:depth], levels[: depth + 1]
        by = f"PARTITION BY {', '.join(parents)}" if parents else ""
        join = f"JOIN g{depth - 1} USING ({', '.join(parents)})" if parents else "CROSS JOIN budget"
        blocks.append(f"""
        n{depth} AS (
          SELECT {", ".join(own)}, sum(tokens * 2)::BIGINT AS capacity, {weight.get(level, "1")} AS weight, any_value(granted) AS granted
          FROM leaves {join} GROUP BY {", ".join(own)}
        ), f{depth} AS (
          SELECT *, capacity * sum(weight) OVER ({by} ORDER BY capacity / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= (granted - coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled
          FROM n{depth}
        ), g{depth} AS (
          SELECT {", ".join(own)}, (CASE WHEN filled THEN capacity ELSE
            (granted - coalesce(sum(capacity) FILTER (filled) OVER ({by}), 0)) * weight // sum(weight) FILTER (NOT filled) OVER ({by}) END)::BIGINT AS granted
          FROM f{depth}
        )""")
    return f"""
        WITH d AS (
          SELECT doc_id, coalesce('domain' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
          FROM documents
        ), leaves AS (
          SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL
        ), budget AS (
          SELECT sum(tokens)::BIGINT // 2 AS granted FROM leaves
        ), {",".join(blocks)}, plan AS (
          SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE granted // tokens END AS epochs, CASE WHEN tokens = 0 THEN 0 ELSE granted % tokens END AS rest
          FROM leaves JOIN g2 USING (domain, lang, source)
        ), placed AS (
          SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || epochs || ':' || doc_id), doc_id) AS upto
          FROM d JOIN plan USING (domain, lang, source)
        )
        SELECT doc_id, domain, lang, source, n_tokens, epochs + (upto <= rest)::BIGINT AS copies
        FROM placed WHERE epochs + (upto <= rest)::BIGINT > 0
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_sentencepiece_sampling": op8_sentencepiece_sampling,
    "op9_html_extraction": op9_html_extraction,
    "op10_license_scan": op10_license_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH t AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        ), g AS (
          SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)
    """,
    "op2_substring_dedup": """
        WITH words AS (
          SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place
          FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
        ), windows AS (
          SELECT doc_id, place, word || ' ' || """
    + " || ' ' || ".join(f"lead(word, {i}) OVER w" for i in range(1, 13))
    + """ AS seq
          FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY place)
        ), firsts AS (
          SELECT seq, min(doc_id) AS first_doc FROM windows WHERE seq IS NOT NULL GROUP BY seq
        ), gone AS (
          SELECT DISTINCT doc_id, unnest(range(place, place + 13)) AS place FROM windows JOIN firsts USING (seq) WHERE first_doc < doc_id
        ), kept AS (
          SELECT doc_id, count(*) AS n_words, count(gone.doc_id) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (gone.doc_id IS NULL) AS kept
          FROM words LEFT JOIN gone USING (doc_id, place) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN kept USING (doc_id)
    """,
    "op4_mix_sources": mix_sql(),
    # Runs of two are joined level by level, then up the proofs one level at a time; crc32 goes bit by bit.
    "op12_merkle_manifest": """
        WITH RECURSIVE coded AS (
          SELECT row_number() OVER () AS row, doc_id, lang,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                 n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
                 list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
                   lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
          FROM documents
        ), leaves AS (
          SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                 sha256(head || coalesce(strlen((n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS seen
          FROM coded
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS place, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves
        ), nodes AS (
          SELECT tree, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY tree) AS size FROM placed
          UNION ALL
          SELECT tree, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (size + 1) // 2 FROM nodes WHERE size > 1 GROUP BY tree, level, place // 2, size
        ), tops AS (
          SELECT 0 AS level, tree AS place, node, count(*) OVER () AS size FROM nodes WHERE size = 1
          UNION ALL
          SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (size + 1) // 2 FROM tops WHERE size > 1 GROUP BY level, place // 2, size
        ), climb AS (
          SELECT row, tree, place, 0 AS level, seen AS node, '' AS proof FROM placed
          UNION ALL
          SELECT row, c.tree, c.place // 2, c.level + 1, sha256(CASE WHEN s.node IS NULL THEN c.node WHEN c.place % 2 = 1 THEN s.node || c.node ELSE c.node || s.node END), proof || coalesce(s.node, '')
          FROM climb c JOIN (SELECT DISTINCT tree, level FROM nodes WHERE size > 1) m ON m.tree = c.tree AND m.level = c.level
          LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.place = xor(c.place, 1)
        ), rest AS (
          SELECT row, tree AS place, 0 AS level, node, proof FROM (SELECT *, max(level) OVER (PARTITION BY row) AS last FROM climb) WHERE level = last
          UNION ALL
          SELECT row, c.place // 2, c.level + 1, sha256(CASE WHEN s.node IS NULL THEN c.node WHEN c.place % 2 = 1 THEN s.node || c.node ELSE c.node || s.node END), proof || coalesce(s.node, '')
          FROM rest c JOIN (SELECT DISTINCT level FROM tops WHERE size > 1) m ON m.level = c.level
          LEFT JOIN tops s ON s.level = c.level AND s.place = xor(c.place, 1)
        )
        SELECT doc_id, leaf, subroot.node AS subroot, root.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = root.node AS verified
        FROM placed JOIN (SELECT *, max(level) OVER (PARTITION BY row) AS last FROM rest) f ON f.row = placed.row AND f.level = f.last
        JOIN nodes subroot ON subroot.tree = placed.tree AND subroot.size = 1 CROSS JOIN (SELECT node FROM tops WHERE size = 1) root
    """,
    "op13_benchmark_decontamination": """
        WITH d AS (
          SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), b AS (
          SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), windows AS (
          SELECT DISTINCT item, width, array_to_string(w[place:place + width - 1], ' ') AS words
          FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS place FROM (SELECT *, least(len(w), 10) AS width FROM b WHERE len(w) > 0))
        ), hits AS (
          SELECT row, place, d.width, item
          FROM (SELECT row, w, width, unnest(range(1, len(w) - width + 2)) AS place FROM d CROSS JOIN (SELECT DISTINCT width FROM windows)) d
          JOIN windows ON windows.width = d.width AND windows.words = array_to_string(d.w[place:place + d.width - 1], ' ')
        ), covered AS (
          SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT row, unnest(range(place, place + width)) AS place FROM hits) GROUP BY row
        ), named AS (
          SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
    """,
}
