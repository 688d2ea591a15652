"""Rows that jobs keep between their steps, and numbers for rows in an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOW = (1 << 33) - 1


def checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: that of spark.checkpoint.dir; only in local mode, where that is unset, one of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sluiceworks-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at if "://" in at else f"file://{at}"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder for checkpoints."""
    return f"{checkpoints(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the folder for checkpoints, which ends their lineage."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet to the folder for checkpoints: smaller than kept, and read by columns."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, name: str, first: int = 0) -> DataFrame:
    """rows with consecutive numbers in the order in which their partitions lie: partitions are counted, and only their counts meet in a running sum.

    The rows must come in the same partitions each time they are read, as a scan's or a checkpoint's do."""
    part = F.shiftright("_id", 33)
    rows = (rows if "_id" in rows.columns else rows.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row for each partition of the input.
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return rows.join(before, "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(_LOW)) + first).drop("_id", "_part", "_before")


def numbered(rows: DataFrame, order: str | list[str], first: int = 1, name: str = "sequence") -> DataFrame:
    """rows with consecutive numbers in an order, counted by range partitions: no task sees all rows."""
    order = [order] if isinstance(order, str) else order
    # Kept with their ids: a shuffle that is read twice may be cut into other partitions the second time.
    return placed(kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())), name, first)
