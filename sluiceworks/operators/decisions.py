"""Channel decisions as one struct: type, intent of a Pass, and the reason of a Block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REASON = "struct<type:string,pattern_id:string,detail:string,intent:string>"
DECISION = f"struct<type:string,intent:string,reason:{REASON},code:string>"


def reason(kind: str | Column, pattern_id: str | Column | None = None, detail: str | Column | None = None, intent: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*(as_column(x).cast("string").alias(n) for n, x in (("type", kind), ("pattern_id", pattern_id), ("detail", detail), ("intent", intent)))).cast(REASON)


def passed(intent: str | Column) -> Column:
    intent = intent if isinstance(intent, Column) else F.lit(intent)
    return F.struct(F.lit("Pass").alias("type"), intent.alias("intent"), F.lit(None).cast(REASON).alias("reason"), F.lit(None).cast("string").alias("code")).cast(DECISION)


def blocked(why: Column) -> Column:
    return F.struct(F.lit("Block").alias("type"), F.lit(None).cast("string").alias("intent"), why.alias("reason"), F.lit(None).cast("string").alias("code")).cast(DECISION)


def fault(code: str) -> Column:
    return F.struct(F.lit("Fault").alias("type"), F.lit(None).cast("string").alias("intent"), F.lit(None).cast(REASON).alias("reason"), F.lit(code).alias("code")).cast(DECISION)


def forbidden(pattern_id: str | Column) -> Column:
    return blocked(reason("ForbiddenPattern", pattern_id=pattern_id))


def malformed(detail: str | Column) -> Column:
    return blocked(reason("MalformedInput", detail=detail))


def label(decision: Column) -> Column:
    """A stable string, as 'Pass:intent' or 'Block:ForbiddenPattern:id'."""
    why = decision["reason"]
    return F.concat_ws(":", decision["type"], decision["intent"], why["type"], F.coalesce(why["pattern_id"], why["detail"], why["intent"]), decision["code"])
