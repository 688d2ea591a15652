"""Disagreements of the channels as an operator reviews them: records of both schema versions read as VARIANT, one table of findings out.

A record keeps whatever fields its version has. Version 2 names what each channel decided; where it does not, as in version 1, both channels are
taken to have blocked for the record's reason, each in half the time. A reason may be an object or a plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analytics

UNKNOWN = "Unknown"
#: What an operator can do with a disagreement, and which of it asks for tuning.
ACTIONS = ["acknowledge", "add_pattern", "add_pattern_auto", "adjust_rule", "false_positive", "true_positive", "defer"]
TUNING = ["add_pattern", "add_pattern_auto", "adjust_rule", "false_positive"]


def records(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """`record` VARIANT of each line that is a JSON object, and the lines that are not; blank lines are neither."""
    parsed = lines.filter(F.trim(value) != "").select(F.col(value).alias("value"), F.try_parse_json(value).alias("record"))
    good = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    return parsed.filter(good).select("record"), parsed.filter(~good).select("value")


def variant_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`records` of a log of JSON lines."""
    return records(spark.read.text(path))


def _text(record: Column, path: str) -> Column:
    """A string as it is, anything else as its JSON; null where there is none."""
    return F.try_variant_get(record, path, "string")


def _reason(record: Column) -> tuple[Column, Column]:
    """Type and pattern of a version 1 record's reason. One that is missing is unknown, one that is null says 'None'."""
    kind, pattern = _text(record, "$.block_reason.type"), _text(record, "$.block_reason.pattern_id")
    present = F.try_variant_get(record, "$.block_reason", "variant")
    plain = F.when(F.is_variant_null(present), "None").when(F.schema_of_variant(present) == "STRING", _text(record, "$.block_reason"))
    return F.coalesce(plain, kind, F.lit(UNKNOWN)), pattern


def channel(record: Column, name: str) -> Column:
    """What a channel decided: STRUCT<decision_type, decision_detail, matched_pattern, matched_fragment, elapsed_us>."""
    at = f"$.channel_{name}_result"
    kind, intent, pattern = (_text(record, f"{at}.decision.{x}") for x in ("type", "intent", "pattern_id"))
    elapsed = F.coalesce(F.try_variant_get(record, f"{at}.elapsed_us", "long"), F.lit(0))
    why = F.coalesce(_text(record, f"{at}.decision.reason"), F.lit(UNKNOWN))
    fault = F.concat(F.lit("Fault: "), F.coalesce(_text(record, f"{at}.decision.code"), F.lit(UNKNOWN)))
    reason, reason_pattern = _reason(record)
    half = F.floor(F.coalesce(F.try_variant_get(record, "$.total_elapsed_us", "long"), F.lit(0)) / 2).cast("long")

    def struct(decision: str | Column, detail: Column, matched: Column, took: Column) -> Column:
        fields = {"decision_type": F.lit(decision) if isinstance(decision, str) else decision, "decision_detail": detail, "matched_pattern": matched, "matched_fragment": F.lit(None).cast("string"), "elapsed_us": took}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    return (
        F.when(kind == "Pass", struct("Pass", F.coalesce(intent, F.lit(UNKNOWN)), pattern, elapsed))
        .when(kind == "Block", struct("Block", why, pattern, elapsed))
        .when(kind == "Fault", struct("Block", fault, F.lit(None).cast("string"), elapsed))
        .otherwise(struct(F.when(reason == "", UNKNOWN).otherwise("Block"), F.coalesce(reason_pattern, reason), reason_pattern, half))
    )


def moment(ns: Column) -> Column:
    """Nanoseconds as a UTC time in ISO form; 'unknown' for none. The session's time zone must be UTC."""
    at = F.timestamp_micros(F.floor(ns.cast("decimal(20,0)") / 1000).cast("long"))  # a double has too few digits
    shown = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(at) % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))
    return F.when(ns.isNotNull() & (ns != 0), shown).otherwise("unknown")


def details(log: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """A row for each record of a disagreement: both channels, the stored texts of its hash, what caused it and what to do.

    texts: hash, input_text, normalised_text, each hash once. A record of version 2 names its version as the cause and whether it has channel data."""
    r = F.col("record")
    rows = log.filter(_text(r, "$.verdict_kind") == "DiagnosticDisagreement").select(
        F.coalesce(F.try_variant_get(r, "$.sequence", "long"), F.lit(0)).alias("sequence"), moment(F.try_variant_get(r, "$.decided_at_ns", "long")).alias("timestamp"),
        F.coalesce(_text(r, "$.input_hash"), F.lit("")).alias("input_hash"), F.coalesce(F.try_variant_get(r, "$.schema_version", "int"), F.lit(1)).alias("schema_version"),
        channel(r, "a").alias("a"), channel(r, "b").alias("b"), F.try_variant_get(r, "$.advisory.score", "int").alias("advisory_score"),
        F.coalesce(F.try_variant_get(r, "$.total_elapsed_us", "long"), F.lit(0)).alias("total_elapsed_us"),
        (F.try_variant_get(r, "$.channel_a_result.decision", "variant").isNotNull() | F.try_variant_get(r, "$.channel_b_result.decision", "variant").isNotNull()).alias("_full"),
    )
    if texts is None:
        rows = rows.withColumns({"input_text": F.lit(None).cast("string"), "normalised_text": F.lit(None).cast("string")})
    else:
        rows = analytics.texts_of(rows, texts.select("hash", "input_text", "normalised_text"))
    version = F.when(F.col("schema_version") >= 2, F.concat(F.lit("[Schema v"), F.col("schema_version").cast("string"), F.lit("] "), F.when(F.col("_full"), "(Full channel data available) ").otherwise("")))
    empty = F.lit("")
    cause = F.coalesce(version, analytics.root_cause(F.col("a.decision_type"), F.col("b.decision_type"), F.coalesce("input_text", empty), F.coalesce("normalised_text", empty)))
    rows = rows.withColumn("root_cause", cause)
    return rows.withColumn("recommendation", analytics.recommendation(F.col("a.decision_type"), F.col("b.decision_type"), F.col("root_cause"))).drop("_full")


def problem_text(detail: DataFrame) -> DataFrame:
    """detail with `problem_text`, what a new pattern would be made from: the text itself, else a fragment that matched, else a pattern; A before B."""
    found = [F.col("input_text"), F.col("a.matched_fragment"), F.col("b.matched_fragment"), F.col("a.matched_pattern"), F.col("b.matched_pattern")]
    return detail.withColumn("problem_text", F.coalesce(*(F.when(c != "", c) for c in found)))


def findings(detail: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """The 14 columns that are exported. actions (sequence, action, notes, timestamp): the last one of a sequence counts."""
    if actions is None:
        rows = detail.withColumns({"operator_action": F.lit(None).cast("string"), "operator_notes": F.lit("")})
    else:
        last = actions.groupBy("sequence").agg(F.max_by(F.struct("action", "notes"), "timestamp").alias("_last"))
        rows = detail.join(last, "sequence", "left").withColumns({"operator_action": F.col("_last.action"), "operator_notes": F.coalesce("_last.notes", F.lit(""))})
    names = {"decision": "decision_type", "detail": "decision_detail", "pattern": "matched_pattern"}
    sides = [F.col(f"{x}.{field}").alias(f"channel_{x}_{name}") for x in ("a", "b") for name, field in names.items()]
    return rows.select("sequence", "timestamp", "input_hash", *sides, "advisory_score", "root_cause", "recommendation", "operator_action", "operator_notes")


def export(rows: DataFrame, path: str) -> None:
    """Findings as JSON lines; null fields are written too, so that every line has all columns."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def exit_code(actions: DataFrame) -> DataFrame:
    """One row: 3 where an operator asked for tuning, else 0, with how many of each action there are."""
    tuned = F.count_if(F.col("action").isin(*TUNING))
    return actions.agg(F.count("*").alias("actions"), tuned.alias("tuning"), F.when(tuned > 0, 3).otherwise(0).alias("exit_code"))
