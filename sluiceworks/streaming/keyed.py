"""Keyed state with event-time timers: sessions, and the review queue with its deadlines.

Both give the rows of their batch forms (`session.evaluated`, `review.transitions`) as their input arrives. State lives in RocksDB, so it is
bounded by disk and not by memory; a timer drops a key's state when the watermark has passed its last use. Rows of one key and one micro-batch are held
together to be put in order, so a batch's size (`maxFilesPerTrigger`, `maxBytesPerTrigger` of the source) bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import review, session
from ..plans.config import GateConfig

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows_of(parts: Iterator[pd.DataFrame], order: list[str]) -> list[Any]:
    """The rows of a key in one batch, in order."""
    held = [p for p in parts if len(p)]
    return list(pd.concat(held).sort_values(order).itertuples(index=False)) if held else []


class Sessions(StatefulProcessor):
    """The last messages of a session as (indicators, fragment) and when it began and was last heard; rows: at_us, seq, first, later, fragment, and what goes along."""

    def __init__(self, kept: list[str], timeout_s: int, window: int):
        self.kept, self.timeout_us, self.window = kept, timeout_s * 1_000_000, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "n int, fragment boolean")
        self.clock = handle.getValueState("clock", "began bigint, last bigint, seen bigint, episode bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        began, last, seen, episode = self.clock.get() if self.clock.exists() else (None, None, 0, 0)
        recent = [(int(n), bool(f)) for n, f in self.recent.get()] if self.recent.exists() else []
        out = []
        for r in rows_of(rows, ["at_us", "seq"]):
            if last is not None and r.at_us - last >= self.timeout_us:
                began, seen, recent, episode = None, 0, [], episode + 1
            began, last, seen = r.at_us if began is None else began, r.at_us, seen + 1
            recent = [*recent, (int(r.later), bool(r.fragment)) if seen > 1 else (0, False)][-self.window :]
            counts = [n for n, _ in recent]
            rapid = seen >= session.RAPID and sum(counts[-3:]) >= session.RAPID
            score, known = min(100, 10 * sum(counts)), min(seen, self.window)
            out.append((*key, *(getattr(r, c) for c in self.kept), episode, score, any(f for _, f in recent), rapid, known, min(seen, self.window + 1), r.at_us - began))
        self.recent.put(recent)
        self.clock.update((began, last, seen, episode))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((last + self.timeout_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["session_id", *self.kept, "episode", "escalation_score", "fragmentation_detected", "rapid", "message_count", "message_sequence", "duration_us"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.recent.clear()
        self.clock.clear()
        return iter([])

    def close(self) -> None:
        pass


def sessions(messages: DataFrame, late: str = "10 minutes", config: GateConfig | None = None, timeout_s: int = session.TIMEOUT_S, window: int = session.WINDOW) -> DataFrame:
    """Each message with its verdict and the analysis of its session, as `session.evaluated` has it, but for `episode` and the indicators' names.

    messages: session_id, seq, at (timestamp), text. Messages later than the watermark are dropped. A session that is quiet for the timeout is forgotten. window: 3 at least."""
    df = session.judged(messages, "text", config).withWatermark("at", late)
    found = session.indicators(F.coalesce("heard", F.lit("")), F.lit(2))
    count = sum((c.cast("int") for c in found.values()), F.lit(0))
    kept = ["seq", "at", "verdict_kind", "is_pass"]
    picked = df.select(F.col("session_id").cast("string"), F.col("seq").cast("long"), "at", F.unix_micros("at").alias("at_us"), "verdict_kind", "is_pass", count.alias("later"), found["PayloadFragmentation"].alias("fragment"))
    schema = "session_id string, seq long, at timestamp, verdict_kind string, is_pass boolean, episode long, escalation_score int, fragmentation_detected boolean, rapid boolean, message_count int, message_sequence int, duration_us long"
    out = picked.groupBy("session_id").transformWithStateInPandas(Sessions(kept, timeout_s, window), schema, "append", "EventTime")
    return session.assessed(out).withColumn("alert", F.col("risk_level") == "High").drop("rapid", "episode")


class Reviews(StatefulProcessor):
    """One item: created, deadline, status, and marks that came before it; a timer at the deadline, a later one that ends its state."""

    def __init__(self, keep_ns: int):
        self.keep_ns = keep_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "created bigint, deadline bigint, status string")
        self.early = handle.getListState("early", "at_ns bigint, by string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        created, deadline, status = self.item.get() if self.item.exists() else (None, None, None)
        marks = [(int(a), b) for a, b in self.early.get()] if self.early.exists() else []
        out = []
        for r in rows_of(rows, ["at_ns", "kind", "by"]):
            if r.kind == 1:
                marks.append((int(r.at_ns), r.by))
            elif created is None:
                created, deadline, status = int(r.at_ns), int(r.review_by_ns), "Pending"
                out.append((*key, status, created, None))
        if created is not None:
            usable = min(((a, b) for a, b in marks if a >= created), default=None)
            if usable and status != "Reviewed":
                if usable[0] > deadline and status == "Pending":
                    out.append((*key, "Expired", deadline, None))
                out.append((*key, "Reviewed", *usable))
                status = "Reviewed"
            marks = []
            self.item.update((created, deadline, status))
        if marks:
            self.early.put(marks)
        else:
            self.early.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # Times are kept in ms by timers, so the first one that is later than the deadline.
        until = deadline if status == "Pending" else (deadline or max(a for a, _ in marks)) + self.keep_ns
        self.handle.registerTimer(max(until // 1_000_000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["sequence", "status", "at_ns", "by"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        created, deadline, status = self.item.get() if self.item.exists() else (None, None, None)
        if status == "Pending":
            self.item.update((created, deadline, "Expired"))
            self.handle.registerTimer((deadline + self.keep_ns) // 1_000_000 + 1)
            yield pd.DataFrame([(*key, "Expired", deadline, None)], columns=["sequence", "status", "at_ns", "by"])
        else:
            self.item.clear()
            self.early.clear()

    def close(self) -> None:
        pass


def reviews(audit: DataFrame, marks: DataFrame, late: str = "10 minutes", keep_hours: int = 24 * 30) -> DataFrame:
    """Transitions of review items as two streams arrive: audit rows (sequence, verdict_kind, decided_at_ns, advisory_score) and marks (sequence, by, at_ns).

    An item expires when the watermark has passed its deadline; it is forgotten keep_hours after its deadline, and marks that find no item keep_hours after themselves."""
    items = review.queue(audit).select("sequence", F.lit(0).alias("kind"), F.col("created_at_ns").alias("at_ns"), F.lit(None).cast("string").alias("by"), "review_by_ns")
    named = marks.select("sequence", F.lit(1).alias("kind"), "at_ns", F.col("by").cast("string").alias("by"), F.lit(0).cast("long").alias("review_by_ns"))
    both = items.unionByName(named).withColumn("at", F.timestamp_micros(F.floor(F.col("at_ns") / 1000).cast("long"))).withWatermark("at", late)
    return both.groupBy("sequence").transformWithStateInPandas(Reviews(keep_hours * review.HOUR_NS), "sequence long, status string, at_ns long, by string", "append", "EventTime")


def start(out: DataFrame, path: str, checkpoint: str, spark: SparkSession | None = None) -> Any:
    """The stream into a Parquet table, once through all that is there; it ends by itself."""
    (spark or out.sparkSession).conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return out.writeStream.option("checkpointLocation", checkpoint).format("parquet").option("path", path).outputMode("append").trigger(availableNow=True).start()
