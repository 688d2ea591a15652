"""The review queue: what the channels disagree on waits for a person, with a deadline by how much they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
#: Hours to review by verdict.
DEADLINES = {"DiagnosticDisagreement": 24, "DiagnosticAgreement": 72}


def queue(audit: DataFrame) -> DataFrame:
    """A pending item per audit row that needs review. audit: sequence, verdict_kind, decided_at_ns, advisory_score."""
    hours = F.create_map(*[x for k, v in DEADLINES.items() for x in (F.lit(k), F.lit(v))])
    rows = audit.filter(F.col("verdict_kind").isin(*DEADLINES))
    return rows.select("sequence", "verdict_kind", F.col("decided_at_ns").alias("created_at_ns"), (F.col("decided_at_ns") + hours[F.col("verdict_kind")] * F.lit(HOUR_NS)).alias("review_by_ns"), F.lit("Pending").alias("status"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("long").alias("reviewed_at_ns"), "advisory_score")


def expired(now_ns: Column) -> Column:
    return (F.col("status") == "Pending") & (now_ns > F.col("review_by_ns"))


def pending(items: DataFrame, now_ns: Column) -> DataFrame:
    return items.filter((F.col("status") == "Pending") & ~expired(now_ns))


def mark_reviewed(items: DataFrame, marks: DataFrame, now_ns: Column) -> DataFrame:
    """items with the pending ones reviewed that `marks` (sequence, by) names."""
    marks = marks.groupBy("sequence").agg(F.min("by").alias("_by"))
    hit = (F.col("status") == "Pending") & F.col("_by").isNotNull()
    joined = items.join(marks, "sequence", "left")
    return joined.withColumns({"reviewed_by": F.when(hit, F.col("_by")).otherwise(F.col("reviewed_by")), "reviewed_at_ns": F.when(hit, now_ns).otherwise(F.col("reviewed_at_ns")), "status": F.when(hit, "Reviewed").otherwise(F.col("status"))}).drop("_by")


def stats(items: DataFrame, now_ns: Column) -> DataFrame:
    late = expired(now_ns)
    return items.agg(F.count("*").alias("total"), F.count_if((F.col("status") == "Pending") & ~late).alias("pending"), F.count_if(late).alias("expired"), F.count_if(F.col("status") == "Reviewed").alias("reviewed"))


def transitions(items: DataFrame, marks: DataFrame, now_ns: Column) -> DataFrame:
    """What happened to each item until now: (sequence, status, at_ns, by) with Pending when it was made, Reviewed at its first mark that is not earlier
    than itself, and Expired at its deadline if that passed before a mark came. An item that expired can still be reviewed, as `mark_reviewed` has it.

    marks: sequence, by, at_ns. Of marks at one time the least name counts; marks after now, or of no item, are as if they were not."""
    first = items.select("sequence", "created_at_ns", "review_by_ns").join(marks, "sequence").filter((F.col("at_ns") >= F.col("created_at_ns")) & (F.col("at_ns") <= now_ns))
    first = first.groupBy("sequence").agg(F.min(F.struct("at_ns", "by")).alias("m"))
    known = items.filter(F.col("created_at_ns") <= now_ns).join(first, "sequence", "left")
    late = (now_ns > F.col("review_by_ns")) & (F.col("m").isNull() | (F.col("m.at_ns") > F.col("review_by_ns")))
    row = lambda status, at, by: F.struct(F.lit(status).alias("status"), at.alias("at_ns"), by.cast("string").alias("by"))
    rows = F.array(row("Pending", F.col("created_at_ns"), F.lit(None)), F.when(late, row("Expired", F.col("review_by_ns"), F.lit(None))), F.when(F.col("m").isNotNull(), row("Reviewed", F.col("m.at_ns"), F.col("m.by"))))
    return known.select("sequence", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("t")).select("sequence", "t.*")
