"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import (
    alignment, byte_bpe, byte_cnn, cap_filters, cross_polytope, grammar_secrets, packing, preferences,
    resharding, simhash, spelling, toxicity, warc,
)
from tapeline.llm.tables import read

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), RANKS)


def op2_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         "offset", "bucket")


def op3_spherical_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.placement(spark, f"{sf_dir}/documents.parquet")


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.all_pairs(read(spark, sf_dir, "conversations"))


def op5_whole_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of whole conversations alone."""
    turns = read(spark, sf_dir, "conversations")
    return preferences.paired(turns, preferences.neighbours(turns, alone=True))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(
        read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op7_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.model(docs, labels))


def op8_simhash_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return byte_cnn.score(docs, byte_cnn.model(docs, labels))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_round_trip(read(spark, sf_dir, "pages"))


def op11_shared_cut_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def op12_bloom_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_secrets.scan(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_power_of_two_packing, op3_spherical_cap_dedup, op4_min_cost_resharding,
        op5_preference_formatting, op5_whole_conversations, op6_cross_polytope, op7_ftrl_toxicity,
        op8_simhash_vantage_trees, op9_byte_cnn_quality, op10_warc_round_trip,
        op11_shared_cut_alignment, op12_bloom_spelling_variants,
        op13_grammar_secrets,
    )
}

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
                  sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit'
            ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN w USING (d)
"""

# The others are tested against brute force, exact round trips or held-out accuracy.
ORACLES = {
    "op5_preference_formatting": preferences.ORACLE,
    "op5_whole_conversations": f"SELECT * EXCLUDE (kind) FROM ({preferences.ORACLE}) WHERE kind = 'whole'",
    "op10_warc_round_trip": _WARC,
}
