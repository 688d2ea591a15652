"""Token counts kept as rollups: signed deltas per source, language and tokenizer version, committed by batch.

A change is a row (op, source, lang, tokenizer, n_tokens, old_tokens) with op 'insert', 'delete' or 'revise'.
A batch is aggregated before it is written, and counts once its commit marker is there; applying a batch id
again changes nothing. Null source, lang or tokenizer values form groups of their own; null counts are 0, and an
unknown op counts nothing. Repeated rows count as often as they occur, very long texts whole; a table without rows gives no group. Columns of a table besides
the id, the text, source and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RoundBpe, encoded
from .shared import written

KEYS = ["source", "lang", "tokenizer"]
GROUP = "source string, lang string, tokenizer string"
DELTA = f"{GROUP}, d_docs long, d_tokens long"
#: Batches between two bases, and one in how many documents `batches_of` revises or withdraws.
FOLD, SHARE = 100, 10


def token_counts(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The number of ids of each document (null text: 0) and of its bytes, with its source and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, at in encoded(batches, "text", path, RoundBpe):
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(np.diff(at), pa.int64()), size], ["doc_id", "source", "lang", "n_tokens", "n_bytes"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long, n_bytes long").select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_tokens", "n_bytes")


def signed(changes: DataFrame) -> DataFrame:
    """The additive effect of each group of changes."""
    n, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_tokens", "old_tokens"))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).cast("long")
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - old).otherwise(0)
    return changes.groupBy(*KEYS).agg(F.sum(docs).alias("d_docs"), F.sum(tokens).alias("d_tokens"))


class TokenRollup:
    """Totals in one folder, for one writer at a time.

    A batch is a partition of deltas; `commits` names the batches that count. Every FOLD commits the totals so far are
    written as a base of their own, and with the marker of that base a new generation begins: totals are the newest base and
    the deltas of its generation, at most FOLD batches, however many there were before. The generation before is kept for totals that are not read
    yet; what is older goes.
    """

    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD):
        self.spark, self.every = spark, fold
        self.deltas, self.commits, self.bases, self.folds = (f"{path}/{x}" for x in ("deltas", "commits", "bases", "folds"))

    def _at(self, path: str):  # noqa: ANN202
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _read(self, path: str, schema: str) -> DataFrame:
        fs, at = self._at(path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(at) else self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        return self._read(self.folds, "generation long").agg(F.max("generation")).first()[0] or 0

    def committed(self) -> DataFrame:
        return self._read(self.commits, "batch_id string, generation long")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Add one batch of changes; False if that id is committed already. A batch that died half-way is replaced."""
        if self.committed().filter(F.col("batch_id") == batch_id).take(1):
            return False
        now = self.generation()
        rows = signed(changes).withColumns({"generation": F.lit(now).cast("long"), "batch_id": F.lit(batch_id)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "batch_id").parquet(self.deltas)
        self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(now).cast("long").alias("generation")).coalesce(1).write.mode("append").parquet(self.commits)
        if self.committed().filter(F.col("generation") == now).count() >= self.every:
            self.fold()
        return True

    def fold(self) -> None:
        """Write the totals as a base and begin a new generation; until its marker is written nothing has changed."""
        now = self.generation()
        self.totals().write.mode("overwrite").parquet(f"{self.bases}/{now + 1}")
        self.spark.range(1).select(F.lit(now + 1).cast("long").alias("generation")).coalesce(1).write.mode("append").parquet(self.folds)
        for old in (f"{self.deltas}/generation={now - 1}", f"{self.bases}/{now - 1}"):
            fs, at = self._at(old)
            fs.delete(at, True)

    def totals(self) -> DataFrame:
        """n_docs and n_tokens of every group that committed batches touched, but for those left with neither."""
        now = self.generation()
        counts = self.committed().filter(F.col("generation") == now).select("batch_id").distinct()  # FOLD ids at most, so it may be broadcast
        new = self._read(self.deltas, f"{DELTA}, generation long, batch_id string").filter(F.col("generation") == now).join(F.broadcast(counts), "batch_id", "left_semi")
        base = self._read(f"{self.bases}/{now}", f"{GROUP}, n_docs long, n_tokens long")
        rows = new.select(*KEYS, "d_docs", "d_tokens").union(base)
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")


def batches_of(counts: DataFrame) -> list[tuple[str, DataFrame]]:
    """A table's counts as it comes to be known, as (batch id, changes): one document in SHARE is first taken in with an estimate, a token for four bytes, and revised when it is
    counted; another one in SHARE is taken in, withdrawn, and taken in again. Documents without an id are only taken in."""
    part = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(SHARE)), F.lit(SHARE))
    rows = counts.withColumn("_part", part)
    none = F.lit(None).cast("long")

    def change(rows: DataFrame, op: str, n: Column, old: Column = none) -> DataFrame:
        return rows.select(*KEYS, F.lit(op).alias("op"), n.alias("n_tokens"), old.alias("old_tokens"))

    estimated, withdrawn = rows.filter("_part = 0"), rows.filter("_part = 1")
    exact, guess = F.col("n_tokens"), F.floor(F.col("n_bytes") / 4).cast("long")
    return [
        ("load", change(rows, "insert", F.when(F.col("_part") == 0, guess).otherwise(exact))),
        ("withdrawn", change(withdrawn, "delete", exact)),
        ("counted", change(estimated, "revise", exact, guess)),
        ("returned", change(withdrawn, "insert", exact)),
    ]


def rollup_of(docs: DataFrame, path: str, vocabulary: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Totals of a table that is taken in by several batches of inserts, deletes and revisions (`batches_of`), each of them sent twice."""
    rollup = TokenRollup(docs.sparkSession, path)
    counts = written(token_counts(docs, vocabulary, tokenizer, doc_id, text), "counts")
    for batch_id, changes in batches_of(counts):
        rollup.apply(batch_id, changes)
        rollup.apply(batch_id, changes)
    return rollup.totals()
