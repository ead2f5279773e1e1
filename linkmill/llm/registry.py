"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.llm import byte_bpe, cotraining, cross_polytope, jaccard_join, packing, preferences, quality_rules, suffix_dedup, token_counts, toxicity
from linkmill.llm.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.digests(cotraining.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digests(suffix_dedup.remove_copies(docs))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = preferences.shortened_answers(table(spark, sf_dir, "conversations"))
    return preferences.digests(preferences.preference_pairs(*sides))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digests(quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), fallback=True)


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Query]:
    found = [op1_cotraining, op2_packing, op3_suffix_dedup, op4_preferences, op5_quality_rules, op6_cross_polytope, op7_token_counts, op8_toxicity_chain, op9_ngram_jaccard, op10_byte_bpe]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_preferences": preferences.SQL}
