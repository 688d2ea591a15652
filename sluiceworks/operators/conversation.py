"""Conversations: every message alone and in the context of those before it; the first block ends it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..plans.config import GateConfig
from ..plans.gate import verdicts

#: Added to the sequence of a verdict on a context.
CONTEXT_OFFSET = 100_000


def context_texts(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", window: int = 3) -> DataFrame:
    """messages with `position` from 0 and `context`: the last `window` texts joined by blanks; null for the first message.

    Texts are appended, oldest first, while what is there has at most the byte limit.
    """
    order = Window.partitionBy(conv).orderBy(turn)
    df = messages.withColumn("position", F.row_number().over(order) - 1)
    df = df.withColumn("_last", F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(order.rowsBetween(-(window - 1), 0)))
    grown = F.aggregate("_last", F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x).when(F.octet_length(acc) > V.MAX_BYTES, acc).otherwise(F.concat(acc, F.lit(" "), x)))
    return df.withColumn("context", F.when((F.col("position") > 0) & F.lit(window > 1), grown)).drop("_last")


def message_verdicts(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", config: GateConfig | None = None, base: int = 0) -> DataFrame:
    """One verdict per message: that of its context if only that blocks. Messages after the first block are left out."""
    config = config or GateConfig()
    df = context_texts(messages, conv, turn, text, config.context_window)
    both = df.select(conv, turn, "position", F.explode(F.array(F.struct(F.lit(False).alias("contextual"), F.col(text).alias("_text")), F.struct(F.lit(True).alias("contextual"), F.col("context").alias("_text")))).alias("_v"))
    both = both.select(conv, turn, "position", "_v.contextual", "_v._text").filter("NOT contextual OR _text IS NOT NULL")
    judged = verdicts(both, "_text", config)
    one = judged.groupBy(conv, turn, "position").agg(
        F.min(F.when(~F.col("contextual"), F.struct("is_pass", "verdict_kind"))).alias("own"),
        F.min(F.when(F.col("contextual"), F.struct("is_pass", "verdict_kind"))).alias("joint"),
    )
    by_context = F.col("own.is_pass") & ~F.coalesce(F.col("joint.is_pass"), F.lit(True))
    one = one.select(
        conv, turn, "position", by_context.alias("by_context"),
        F.when(by_context, F.col("joint.verdict_kind")).otherwise(F.col("own.verdict_kind")).alias("verdict_kind"),
        (F.col("own.is_pass") & ~by_context).alias("is_pass"),
        (F.lit(base) + F.col("position") + F.when(by_context, CONTEXT_OFFSET).otherwise(0)).cast("long").alias("sequence"),
    )
    first = F.min(F.when(~F.col("is_pass"), F.col("position"))).over(Window.partitionBy(conv))
    return one.withColumn("first_block_index", first).filter("first_block_index IS NULL OR position <= first_block_index")


def conversation_verdicts(judged: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation is_pass, first_block_index and how many verdicts there are."""
    return judged.groupBy(conv).agg(F.min("is_pass").alias("is_pass"), F.min("first_block_index").cast("int").alias("first_block_index"), F.count("*").alias("n_verdicts"))


def pairs(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each assistant message with the message before it, if that is a user's."""
    order = Window.partitionBy(conv).orderBy(turn)
    before: Column = F.lag(F.struct(F.col(role).alias("role"), F.col(text).alias("text"))).over(order)
    return messages.withColumn("_p", before).filter(f"{role} = 'assistant' AND _p.role = 'user'").select(conv, turn, F.col("_p.text").alias("prompt"), F.col(text).alias("response"))
