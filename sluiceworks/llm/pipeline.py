"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and keeps the columns of documents.

Texts that are null, empty or very long, ties, repeated rows, further columns and empty tables are as each stage's operator has them; a document without an id
goes at the first stage, since no later one can name it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join as similar
from . import language_id as languages
from . import packing
from . import quality_rules as rules
from . import suffix_dedup as repeats
from .queries import VOCABULARY
from .shared import written

#: Log-probability units a letter.
POOR_FIT = -3.0

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose doc_id is in `kept`; a document without an id can't be named and goes."""
    return docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    # Aggregated before the filter: a filter right on the projection would be pushed into it, array steps and all.
    verdicts = rules.quality_rules(docs).groupBy("doc_id").agg(F.bool_and("kept").alias("kept"))
    return only(docs, verdicts.filter("kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those go that have no letter, whose letters no learned language holds a quarter of
    (as in a script that none of them uses), or whose letters fit the language by POOR_FIT or more worse than its training texts."""
    found = languages.language_id(docs, languages.fit(docs))
    return only(docs, found.filter((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= 0.25) & (F.col("fit") >= POOR_FIT)))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links hold together; a repeated row stays once."""
    return only(docs, similar.jaccard_classes(docs).filter("component_id = doc_id")).dropDuplicates(["doc_id"])


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has; n_chars follows the text."""
    return repeats.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places."""
    return packing.best_fit_packing(docs, VOCABULARY)


def chained(spark: SparkSession, stages: list[tuple[str, Stage]], sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in stages[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return stages[-1][1](spark, docs, sf_dir)
