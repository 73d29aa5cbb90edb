"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmesh.llm import fingerprints, host_reputation, maxent_lm, mixing, ngram_join, packing, personal_data, quality_classifier, quality_rules, token_alignment, token_counts, toxicity, vector_codes
from lexmesh.llm.shared import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_texts(documents(spark, sf_dir))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir))


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels(spark, sf_dir))


def op9_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op11_anchor_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.link_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_digests(documents(spark, sf_dir))


def op13_adaptive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cotraining_quality, op2_section_tokens, op3_lexicon_automata, op4_hashed_maxent, op5_decision_list, op6_systematic_mix, op7_shingle_join, op8_host_reputation, op9_deficit_packing, op10_canonical_digest, op11_anchor_alignment, op12_deobfuscated_pii, op13_adaptive_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op6_systematic_mix": mixing.ORACLE, "op7_shingle_join": ngram_join.ORACLE, "op8_host_reputation": host_reputation.ORACLE, "op13_adaptive_codes": vector_codes.oracle()}
