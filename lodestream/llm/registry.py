"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import balanced_mix, chat_format, decontaminate, divergence, fingerprints, hard_negatives, licenses, ngram_lm, quality_rules, sharding, simhash, token_lengths, wrapper_extract
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_report(read(spark, sf_dir, "conversations"))


def op3_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.length_histogram(token_lengths.encoded_lengths(read(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_report(read(spark, sf_dir, "documents"), order=3, min_count=1)


def op7_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_mix.mix_report(read(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(read(spark, sf_dir, "documents"))


def op9_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.extract(read(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.notices(spark))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mining_report(read(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_benchmark_decontamination": decontaminate.oracle_sql(),
        "op10_license_scan": licenses.oracle_sql(),
        "op11_hard_negatives": hard_negatives.oracle_sql(),
        "op13_source_divergence": divergence.oracle_sql(),
    }
