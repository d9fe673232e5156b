"""The registered queries of this folder: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (contamination, divergence, importance, licenses, minhash, packing, quality, repair, substrings, token_counts, topk,
               toxicity, word_table)
from .common import shared_path, table
from .tokens import vocabulary_path

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(WORD_VOCABULARY))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY))


def op6_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary_path(WORD_VOCABULARY))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY),
                                     shared_path(spark, "token-counts"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_quality_rules, op3_license_scan, op4_minhash_near_dedup, op5_repair_token_ids,
    op6_word_table_bpe, op7_toxicity, op8_exact_top_k, op9_token_counts, op10_substring_dedup,
    op11_decontamination, op12_source_divergence, op13_importance_resampling)}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.report_sql(), "op8_exact_top_k": topk.top_k_sql(),
    "op11_decontamination": contamination.contamination_sql(), "op12_source_divergence": divergence.divergences_sql()}
