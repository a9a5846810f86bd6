"""Registered queries of the subpackage: one per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, hard_negatives, html_text, jaccard_join, language_id, line_dedup, merkle, packing, phrase_dedup, quality_rules, secret_scan,
               suffix_dedup, token_counts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


@_register
def op1_suffix_array_dedup(spark: SparkSession, path: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, path, "documents"))


@_register
def op2_ngram_jaccard_join(spark: SparkSession, path: str) -> DataFrame:
    return jaccard_join.linked(_table(spark, path, "documents"), n=3, num=90, den=100)


@_register
def op3_benchmark_decontamination(spark: SparkSession, path: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, path, "documents"), _table(spark, path, "benchmark"))


@_register
def op4_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    return phrase_dedup.digest(_table(spark, path, "documents"))


@_register
def op5_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    return line_dedup.digest(_table(spark, path, "documents"))


ORACLES["op5_line_dedup"] = line_dedup.SQL


@_register
def op6_language_id(spark: SparkSession, path: str) -> DataFrame:
    return language_id.language_id(_table(spark, path, "documents"))


@_register
def op7_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, path, "documents"), _table(spark, path, "labels"))


@_register
def op8_html_extraction(spark: SparkSession, path: str) -> DataFrame:
    return html_text.extract(_table(spark, path, "pages"))


@_register
def op9_best_fit_packing(spark: SparkSession, path: str) -> DataFrame:
    return packing.pack(_table(spark, path, "documents"))


@_register
def op10_secret_scans(spark: SparkSession, path: str) -> DataFrame:
    return secret_scan.digest(_table(spark, path, "documents"))


@_register
def op11_merkle_dataset_manifest(spark: SparkSession, path: str) -> DataFrame:
    return merkle.digest(_table(spark, path, "documents"))


ORACLES["op11_merkle_dataset_manifest"] = merkle.SQL


@_register
def op12_token_counts(spark: SparkSession, path: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, path, "documents"))


@_register
def op13_hard_negative_mining(spark: SparkSession, path: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, path, "embeddings"))


ORACLES["op13_hard_negative_mining"] = hard_negatives.SQL
