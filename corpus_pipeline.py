"""The corpus pipeline: each stage applies one training-data operator to what its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All stages but the last return the columns of
`documents`; the last adds `shard` and `slot`. SQL cannot express fingerprints, balanced samples and
hashed orders, so ORACLE_SQL is None and tests compare `run` with a brute-force version.

Decisions: rejected documents go and boilerplate lines are cut; one document of each group of near copies
(five-word shingles, Jaccard coefficient of 0.8 or more) stays; documents that contain a benchmark item go; each document is there as many times as the mixture takes
it; every row gets its shard and its slot in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import balanced_mix, common, decontaminate, near_copies, quality_rules, sharding


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return balanced_mix.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixture),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
