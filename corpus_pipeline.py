"""The corpus pipeline: five stages, each one of the corpus operators, from documents to shards.

Every stage works on all rows that the one before kept, and all but the last return the columns of
``documents``. Rows are never sampled or cut; what a stage removes or repeats is its operator's decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraquill.llm import decontamination, language_id, mixing, near_dedup, sharding
from terraquill.llm.common import Scratch

SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.accepted(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.expand_mix(docs, mixing.mix_sources(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and place."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
    ("sharding", shards),
]

#: The stages can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
