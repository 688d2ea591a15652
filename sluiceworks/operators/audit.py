"""Audit rows and their HMAC chain."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import kept, numbered
from .decisions import DECISION, REASON

SCHEMA_VERSION = 2
ADVISORY = "struct<type:string,score:int,heuristic_version:int>"


def entries(judged: DataFrame, sequence: Column, ingested_ns: Column, decided_ns: Column, detailed: bool = False) -> DataFrame:
    """Rows of schema version 2 from verdicts; both channels are kept where `detailed`."""
    channel = lambda c: F.col(c) if detailed else F.lit(None).cast(DECISION)
    return judged.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), sequence.cast("long").alias("sequence"), ingested_ns.cast("long").alias("ingested_at_ns"), decided_ns.cast("long").alias("decided_at_ns"),
        ((decided_ns - ingested_ns) / 1000).cast("long").alias("total_elapsed_us"), "verdict_kind", "input_hash", "block_reason", "advisory",
        channel("channel_a").alias("channel_a_result"), channel("channel_b").alias("channel_b_result"), F.lit("Detailed" if detailed else "Basic").alias("audit_detail_level"), "early",
        F.lit(None).cast("string").alias("egress_verdict"), F.lit(None).cast("struct<type:string,detail:string>").alias("egress_reason"),
    )


def link(key: bytes, sequence: int, ingested: int, decided: int, digest: str, before: str | None) -> str:
    """HMAC over the little-endian numbers (8, 16 and 16 bytes), the input's hash and the link before."""
    message = sequence.to_bytes(8, "little") + ingested.to_bytes(16, "little") + decided.to_bytes(16, "little") + digest.encode() + (before or "").encode()
    return hmac.new(key, message, hashlib.sha256).hexdigest()


def egress_entries(judged: DataFrame, sequence: Column, ingested_ns: Column, decided_ns: Column) -> DataFrame:
    """Rows of schema version 2 from egress verdicts: the hash is the prompt's, there is no block reason, and the egress fields say what was found."""
    null = lambda kind: F.lit(None).cast(kind)
    return judged.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), sequence.cast("long").alias("sequence"), ingested_ns.cast("long").alias("ingested_at_ns"), decided_ns.cast("long").alias("decided_at_ns"),
        ((decided_ns - ingested_ns) / 1000).cast("long").alias("total_elapsed_us"), F.col("egress_kind").alias("verdict_kind"), "input_hash", null(REASON).alias("block_reason"), null(ADVISORY).alias("advisory"),
        null(DECISION).alias("channel_a_result"), null(DECISION).alias("channel_b_result"), F.lit("Basic").alias("audit_detail_level"), F.lit(False).alias("early"),
        F.col("egress_kind").alias("egress_verdict"), F.col("egress_reason").cast("struct<type:string,detail:string>").alias("egress_reason"),
    )


def chain(rows: DataFrame, key: bytes, chain_id: str = "chain_id", first: str | None = None, heads: DataFrame | None = None) -> DataFrame:
    """rows with chain_hmac. A chain runs through its rows by sequence and streams through one task; chains are independent.

    rows: chain_id, sequence, ingested_at_ns, decided_at_ns, input_hash and any others. heads (chain_id, chain_hmac) has the last link of chains
    that go on; a chain that it does not name begins with `first`. A link needs the one before it, so a single chain can't be computed in parallel; checking one can (`verified`)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("chain_hmac", T.StringType())])
    if heads is None:
        linked = rows.withColumn("_first", F.lit(first).cast("string"))
    else:
        linked = rows.join(heads.select(F.col("chain_id").alias("_of"), F.col("chain_hmac").alias("_head")), F.col(chain_id) == F.col("_of"), "left").withColumn("_first", F.coalesce("_head", F.lit(first).cast("string"))).drop("_of", "_head")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, before = object(), None
        for part in parts:
            out = []
            for c, s, i, d, h, f in zip(part[chain_id], part["sequence"], part["ingested_at_ns"], part["decided_at_ns"], part["input_hash"], part["_first"], strict=True):
                if c != at:
                    at, before = c, f
                before = link(key, int(s), int(i), int(d), h or "", before)
                out.append(before)
            yield part.drop(columns="_first").assign(chain_hmac=out)

    return linked.repartition(chain_id).sortWithinPartitions(chain_id, "sequence").mapInPandas(run, schema)


def last_links(chained: DataFrame, chain_id: str = "chain_id") -> DataFrame:
    """(chain_id, chain_hmac) of each chain's last row, for the next batch."""
    return chained.groupBy(F.col(chain_id).alias("chain_id")).agg(F.max_by("chain_hmac", "sequence").alias("chain_hmac"))


def verified(chained: DataFrame, key: bytes, chain_id: str = "chain_id", first: str | None = None) -> DataFrame:
    """chained with `valid`: whether a row's link follows from its own fields and the stored link before it.

    Rows are numbered by ranges of (chain, sequence) and meet the row before them by number, so one chain of any length is checked by all tasks.
    A row whose fields were changed is invalid; a changed or missing link makes itself and the row behind it invalid."""

    @F.pandas_udf("string")
    def again(s: pd.Series, i: pd.Series, d: pd.Series, h: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([link(key, int(a), int(b), int(c), x or "", y) for a, b, c, x, y in zip(s, i, d, h, before, strict=True)], dtype=object)

    rows = kept(numbered(chained, [chain_id, "sequence"], 0, "_at"))
    before = rows.select((F.col("_at") + 1).alias("_at"), F.col(chain_id).alias("_chain"), F.col("chain_hmac").alias("_link"))
    both = rows.join(before, "_at", "left").withColumn("_link", F.when(F.col(chain_id).eqNullSafe(F.col("_chain")), F.col("_link")).otherwise(F.lit(first).cast("string")))
    right = again("sequence", "ingested_at_ns", "decided_at_ns", "input_hash", "_link")
    return both.withColumn("valid", F.col("chain_hmac").eqNullSafe(right)).select(*chained.columns, "valid")
