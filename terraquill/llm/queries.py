"""The queries of the corpus operators and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquill.llm import (
    decontamination, language_id, license_scan, lm_scoring, mixing, near_dedup, oracles, pii, quality_classifier, quality_rules, sharding,
    source_audit, token_alignment, url_filter,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(documents(spark, sf_dir), 8)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def op4_class_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.class_scores(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).drop("spans")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(documents(spark, sf_dir))


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.array_join("base_spans", ",")
    return pii.find_pii(documents(spark, sf_dir)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat("base_spans", "context_spans"), ",").alias("spans"),
    )


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.host_quality_rules(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def op10_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(documents(spark, sf_dir))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(documents(spark, sf_dir))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_quality": op1_site_quality,
    "op2_minimax_sharding": op2_minimax_sharding,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_class_lm_scoring": op4_class_lm_scoring,
    "op5_license_scan": op5_license_scan,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_contextual_pii": op7_contextual_pii,
    "op8_host_quality_rules": op8_host_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_budget_mixing": op10_budget_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_source_audit": op12_source_audit,
    "op13_url_filter": op13_url_filter,
}

SQL: dict[str, str] = {
    "op3_benchmark_decontamination": oracles.DECONTAMINATION,
    "op6_near_duplicates": oracles.NEAR_DUPLICATES,
    "op12_source_audit": oracles.SOURCE_AUDIT,
    "op13_url_filter": oracles.url_filter(),
}
