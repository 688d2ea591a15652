"""A bitmap of ids, small enough for every task, that lets most rows of other ids go before a join.

Each id sets one of 2**bits bits, 32 to 64 times as many as there are ids, up to MOST_BITS (32 MB). Rows of other ids that
share a bit pass, so an exact join has to follow; with more ids than bits nearly all rows pass, and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS, LEAST_BITS, BLOCK_BITS = 28, 16, 16


class Members:
    """The bitmap of the distinct values of a column."""

    def __init__(self, ids: DataFrame, column: str = "doc_id"):
        self.bits = min(MOST_BITS, max(LEAST_BITS, (32 * ids.count()).bit_length()))
        spark, place = ids.sparkSession, self.place(column)
        slots = ids.select(place.alias("slot")).distinct().select(F.shiftright("slot", BLOCK_BITS).alias("block"), (F.col("slot") % (1 << BLOCK_BITS)).alias("at"))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                block, at = batch.column("block").to_numpy(), batch.column("at").to_numpy()
                for b in np.unique(block).tolist():
                    held.setdefault(b, np.zeros(1 << BLOCK_BITS, dtype=bool))[at[block == b]] = True
            packed = [zstandard.compress(np.packbits(x).tobytes(), 1) for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], ["block", "bits"])

        bitmap = np.zeros((1 << (self.bits - BLOCK_BITS), (1 << BLOCK_BITS) // 8), dtype=np.uint8)
        for r in slots.repartition("block").mapInArrow(blocks, "block long, bits binary").collect():  # at most 1 << (bits - BLOCK_BITS) rows
            bitmap[r["block"]] = np.frombuffer(zstandard.decompress(r["bits"]), dtype=np.uint8)
        self.sent = spark.sparkContext.broadcast(bitmap.ravel())

    def place(self, column: str) -> Column:
        """The bit of an id; null ids have none."""
        return F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(column), F.lit(1 << self.bits)))

    def has(self, place: pa.Array) -> np.ndarray:
        """Inside a task: which of these bits are set."""
        at = place.fill_null(0).to_numpy(zero_copy_only=False)
        return ((self.sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool) & place.is_valid().to_numpy(zero_copy_only=False)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "sent": self.sent}


def perhaps(df: DataFrame, members: Members, inside: bool = True, column: str = "doc_id") -> DataFrame:
    """The rows whose id may be one of the members; with inside=False those whose id is none of them, for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = members.has(batch.column("_place")) == inside
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(keep))

    return df.withColumn("_place", members.place(column)).mapInArrow(run, df.schema)
