"""Streams: prompts to verdicts, trends by event time, and a rolling alert by record count."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.config import GateConfig
from ..plans.gate import verdicts


def prompts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def judge(stream: DataFrame, path: str, checkpoint: str, text: str = "text", config: GateConfig | None = None, also: Callable[[DataFrame], None] | None = None) -> Any:
    """Verdicts of each batch written once under its number; `also` sees the batch, and its errors stop nothing."""

    def write(batch: DataFrame, number: int) -> None:
        out = verdicts(batch, text, config).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        if also is not None:
            try:
                also(batch.sparkSession.read.parquet(path).filter(F.col("batch") == number))
            except Exception as e:
                print(f"listener failed on batch {number}: {e}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def trend(audit: DataFrame, bin_: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """DA and DD counts by tumbling window of the decision time; later rows than the watermark are dropped."""
    at = F.timestamp_micros((F.col("decided_at_ns") / 1000).cast("long"))
    rows = audit.withColumn("decided_at", at).withWatermark("decided_at", late)
    return rows.groupBy(F.window("decided_at", bin_)).agg(F.count("*").alias("total"), F.count_if(F.col("verdict_kind") == "DiagnosticAgreement").alias("da"), F.count_if(F.col("verdict_kind") == "DiagnosticDisagreement").alias("dd"))


def rolling_alert(audit: DataFrame, size: int, key: str = "stream_id", threshold: float = 5.0) -> DataFrame:
    """Share of DA over the last `size` records of each stream, and whether it is above the threshold."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = deque(state.get[0] if state.exists else [], maxlen=size)
        agreed = sum(last)
        rows = pd.concat(list(parts)).sort_values("sequence")
        out = []
        for s, v in zip(rows["sequence"], rows["verdict_kind"], strict=True):
            agreed -= last[0] if len(last) == size else 0
            last.append(int(v == "DiagnosticAgreement"))
            agreed += last[-1]
            rate = 100.0 * agreed / len(last)
            out.append((k[0], s, rate, rate > threshold))
        state.update((list(last),))
        yield pd.DataFrame(out, columns=["stream_id", "sequence", "da_pct", "alert"])

    picked = audit.select(F.col(key).cast("string").alias("stream_id"), "sequence", "verdict_kind")
    return picked.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, sequence bigint, da_pct double, alert boolean", "last array<int>", "append", GroupStateTimeout.NoTimeout)
