"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quire.llm import collision, decontaminate, language, licenses, mixture, perspectives, repeats, superminhash, tokens, toxicity
from quire.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op2_training_order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_collision_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.digest(table(spark, sf_dir, "embeddings"))


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.digest(table(spark, sf_dir, "conversations"))


def op7_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.digest(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.digest(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_training_order_tokens, op3_language_mixture, op4_toxicity_ftrl, op5_collision_near_dedup, op6_perspective_rotation, op7_superminhash_near_dedup, op8_benchmark_decontamination, op9_source_mixture, op10_suffix_array_dedup)
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op5_collision_near_dedup": collision.ORACLE_SQL,
    "op6_perspective_rotation": perspectives.ORACLE_SQL,
    "op7_superminhash_near_dedup": superminhash.ORACLE_SQL,
    "op8_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op9_source_mixture": mixture.ORACLE_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
