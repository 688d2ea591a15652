"""The queries of the training-data operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import html_extraction, jaccard_join, language_id, license_scan, media, packing, prefix_trie, quality_classifier, quality_rules, suffix_dedup, token_counts, vector_codes
from .bpe import bpe_round_trip
from .shared import new_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), VOCABULARY)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_classifier.quality_classifier(docs, quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.html_extraction(spark.read.parquet(f"{sf_dir}/pages.parquet"), html_extraction.trained())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.language_id(docs, language_id.fit(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.rollup_of(documents(spark, sf_dir), new_path(spark, "token-counts"), VOCABULARY, "byte_bpe_50k")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), VOCABULARY)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ALL = [
    op1_jaccard_join, op2_suffix_dedup, op3_bpe, op4_quality_classifier, op5_media_columns, op6_html_extraction, op7_language_id, op8_token_counts, op9_best_fit_packing, op10_quality_rules,
    op11_license_scan, op12_prefix_trie, op13_vector_codes,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {"op10_quality_rules": quality_rules.oracle_sql(), "op12_prefix_trie": prefix_trie.oracle_sql(), "op13_vector_codes": vector_codes.oracle_sql()}
