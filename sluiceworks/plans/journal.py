"""The audit journal: verdicts, their chain and their review items written as one transaction a batch.

A batch writes a partition of each table, then its marker; only batches with a marker count. A batch that died half-way, whatever it had written, is written
anew under its number; a batch that is applied again does nothing. The last link of every chain is a table of its own, written whole by each batch, so a chain
goes on where the last batch that counts left it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, review
from . import gate
from .config import GateConfig

AUDIT, REVIEWS, HEADS, COMMITS = "audit", "reviews", "heads", "commits"
HEAD = "chain_id string, chain_hmac string"


class Journal:
    """Tables in one folder that driver and executors share, for one writer at a time. Batches have rising numbers."""

    def __init__(self, spark: SparkSession, path: str, key: bytes, first: str | None = None, config: GateConfig | None = None):
        self.spark, self.path, self.key, self.first, self.config = spark, path.rstrip("/"), key, first, config or GateConfig()

    def _there(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def committed(self) -> DataFrame:
        return self.spark.read.schema("batch long").parquet(f"{self.path}/{COMMITS}") if self._there(COMMITS) else self.spark.createDataFrame([], "batch long")

    def read(self, name: str) -> DataFrame:
        """The rows of a table that count."""
        return self.spark.read.parquet(f"{self.path}/{name}").join(self.committed().distinct(), "batch", "left_semi")

    def heads(self) -> DataFrame:
        """The last link of each chain after the last batch that counts."""
        last = self.committed().agg(F.max("batch")).first()[0]
        if last is None:
            return self.spark.createDataFrame([], HEAD)
        return self.spark.read.schema(f"{HEAD}, batch long").parquet(f"{self.path}/{HEADS}").filter(F.col("batch") == last).drop("batch")

    def apply(self, batch: int, entries: DataFrame, chain_id: Column | None = None) -> bool:
        """Write one batch of audit rows (`audit.entries`, `audit.egress_entries`), False if it counts already. Rows that were refused
        before any channel judged them have no link and no review item; egress rows have a link and no review item."""
        if self.committed().filter(F.col("batch") == batch).take(1):
            return False
        before = self.heads()
        entries = entries.withColumn("chain_id", (F.lit("audit") if chain_id is None else chain_id).cast("string"))
        chained = audit.chain(entries.filter("NOT early"), self.key, first=self.first, heads=before)
        rows = chained.unionByName(entries.filter("early").withColumn("chain_hmac", F.lit(None).cast("string")))
        self._write(rows, AUDIT, batch)
        # From here on the batch's own rows are read, so that no table can differ from another.
        own = self.spark.read.parquet(f"{self.path}/{AUDIT}").filter(F.col("batch") == batch)
        tracked = own.filter("NOT early AND egress_verdict IS NULL").withColumn("advisory_score", F.when(F.col("advisory.type") == "Disagreement", F.col("advisory.score")))
        self._write(review.queue(tracked), REVIEWS, batch)
        now = audit.last_links(own.filter("NOT early"))
        self._write(now.union(before.join(now, "chain_id", "left_anti")), HEADS, batch)
        self.spark.range(1).select(F.lit(batch).cast("long").alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.path}/{COMMITS}")
        return True

    def verified(self) -> DataFrame:
        """The chained rows that count, with whether each follows from the one before it."""
        return audit.verified(self.read(AUDIT).filter("chain_hmac IS NOT NULL"), self.key, first=self.first)

    def entries(self, batch: DataFrame, text: str = "text", prompt: str = "prompt", response: str = "response", at: str = "at_ns") -> DataFrame:
        """Audit rows of a mixed batch: rows with a response are screened as egress, all others are judged as prompts. batch: sequence and the named columns."""
        detailed = self.config.audit_detail_level == "Detailed"
        judged = gate.verdicts(batch.filter(F.col(response).isNull()), text, self.config)
        screened = gate.egress_verdicts(batch.filter(F.col(response).isNotNull()), prompt, response)
        sequence, when = F.col("sequence"), F.col(at)
        return audit.entries(judged, sequence, when, when, detailed).unionByName(audit.egress_entries(screened, sequence, when, when))

    def follow(self, stream: DataFrame, checkpoint: str, also: Callable[[int], None] | None = None) -> Any:
        """Every micro-batch of a stream (see `entries`) as a batch of the journal; a batch that is replayed after a failure counts once. `also` is told of each."""

        def write(rows: DataFrame, number: int) -> None:
            self.apply(number, self.entries(rows))
            if also is not None:
                also(number)

        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
