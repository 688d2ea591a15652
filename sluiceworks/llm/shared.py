"""Where jobs keep intermediate tables: the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, as in tests, a folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="sluiceworks-")
        spark.sparkContext.setCheckpointDir(at)
    return at if "://" in at else f"file://{at}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back, which ends their lineage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs whose results are written: its cleaner follows the JVM's collector."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
