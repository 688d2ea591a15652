"""The corpus pipeline: quality rules, language ID, n-gram Jaccard join, suffix-array dedup, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluiceworks.llm import pipeline

#: (name, function); each function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("quality_rules", pipeline.quality_rules),
    ("language_id", pipeline.language_id),
    ("jaccard_join", pipeline.jaccard_join),
    ("suffix_array_dedup", pipeline.suffix_array_dedup),
    ("best_fit_packing", pipeline.best_fit_packing),
]

#: Tokenization, language models and byte-wise deduplication are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over `documents`, each written and read again before the next."""
    return pipeline.chained(spark, STAGES, sf_dir)
