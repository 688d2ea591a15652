"""Session analysis over a sliding window of messages; everything is a window function by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import normalise
from ..functions.text import contains_any, literals
from ..plans.config import GateConfig
from ..plans.gate import verdicts

#: Limits of the analysis. A message leaves its hash, of 64 characters, to compare with.
WINDOW, HASH, TIMEOUT_S = 10, 64, 3600
HIGH_SCORE, LONG, RAPID = 70, 8, 3
CONTINUES = ["and then", "after that", "next", "finally"]
#: What each risk and each flag recommends.
ADVICE = {
    "High": ["Consider session termination or human review", "Implement rate limiting for this session"],
    "Medium": ["Monitor session closely for escalation", "Consider increasing scrutiny of future requests"],
    "Low": ["Continue normal monitoring"],
    "HighEscalationScore": ["High escalation score requires attention"],
    "FragmentationDetected": ["Potential payload fragmentation detected"],
    "RapidEscalation": ["Rapid escalation pattern detected"],
    "LongSession": ["Long session may indicate sophisticated probing"],
}


def indicators(text: Column, position: Column) -> dict[str, Column]:
    """Which indicators a message at a position from 1 shows."""
    later, size = position > 1, F.octet_length(text)
    ended = F.rtrim(text).rlike(r"[.!?]\z")
    return {
        "ComplexityEscalation": later & (size > 2 * HASH),
        "TopicDrift": F.lit(False),
        "PolicyTesting": later & (size > 10) & (F.abs(size - HASH) < 20),
        "RepetitionWithVariation": F.lit(False),
        "PayloadFragmentation": later & ((~ended & (size < 100)) | contains_any(F.lower(text), CONTINUES)),
    }


def analyse(messages: DataFrame, session: str | list[str] = "session_id", order: str | list[str] = "seq", text: str = "text", window: int = WINDOW) -> DataFrame:
    """messages with indicators, escalation_score, flags, risk_level, message_count, message_sequence and recommendations."""
    by = Window.partitionBy(session).orderBy(order)
    last, three = by.rowsBetween(-(window - 1), 0), by.rowsBetween(-2, 0)
    df = messages.withColumn("_rn", F.row_number().over(by))
    found = indicators(F.coalesce(F.col(text), F.lit("")), F.col("_rn"))
    df = df.withColumn("indicators", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]), lambda x: x.isNotNull()))
    df = df.withColumns({"_n": F.size("indicators"), "_f": F.array_contains("indicators", "PayloadFragmentation").cast("int")})
    df = df.withColumns(
        {
            "escalation_score": F.least(F.lit(100), 10 * F.sum("_n").over(last)).cast("int"),
            "fragmentation_detected": F.max("_f").over(last) == 1,
            "rapid": (F.col("_rn") >= RAPID) & (F.sum("_n").over(three) >= RAPID),
            "message_count": F.least(F.col("_rn"), F.lit(window)),
            "message_sequence": F.least(F.col("_rn"), F.lit(window + 1)),
        }
    )
    return assessed(df).drop("_rn", "_n", "_f", "rapid")


def assessed(df: DataFrame) -> DataFrame:
    """df with flags, risk_level and recommendations, from escalation_score, fragmentation_detected, rapid and message_count."""
    flags = [("HighEscalationScore", F.col("escalation_score") >= HIGH_SCORE), ("FragmentationDetected", F.col("fragmentation_detected")), ("RapidEscalation", F.col("rapid")), ("LongSession", F.col("message_count") >= LONG)]
    df = df.withColumn("flags", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags]), lambda x: x.isNotNull()))
    df = df.withColumn("risk_level", F.when(F.size("flags") == 0, "Low").when(F.size("flags") <= 2, "Medium").otherwise("High"))
    advice = F.create_map(*[x for k, v in ADVICE.items() for x in (F.lit(k), literals(v))])
    return df.withColumn("recommendations", F.concat(advice[F.col("risk_level")], F.flatten(F.transform("flags", lambda f: advice[f]))))


def episodes(messages: DataFrame, at: str, session: str = "session_id", order: str = "seq", timeout_s: int = TIMEOUT_S) -> DataFrame:
    """messages with `episode` from 0: after a pause of the timeout or longer a session begins anew. at: a timestamp."""
    by = Window.partitionBy(session).orderBy(at, order)
    pause = F.unix_micros(at) - F.unix_micros(F.lag(at).over(by))
    return messages.withColumn("_new", F.when(pause >= timeout_s * 1_000_000, 1).otherwise(0)).withColumn("episode", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def judged(messages: DataFrame, text: str = "text", config: GateConfig | None = None) -> DataFrame:
    """messages with the verdict on each normalised text, which is what a session hears: verdict_kind, is_pass, block_reason, and `heard`.

    The text is normalised before the gate normalises it, so what the first pass drops is not held against it. A text that is too long to
    be normalised is judged as it is."""
    df = messages.withColumn("_n", normalise(F.col(text))).withColumn("heard", F.coalesce("_n.text", text)).drop("_n")
    kept = [*messages.columns, "heard", "verdict_kind", "is_pass", "block_reason"]
    return verdicts(df, "heard", config).select(kept)


def evaluated(messages: DataFrame, at: str, session: str = "session_id", order: str = "seq", text: str = "text", config: GateConfig | None = None, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """Every message with its verdict, the analysis of its session up to it, the session's duration, and whether it is an alert: a risk that is high.

    A session's analysis never changes a verdict."""
    df = episodes(judged(messages, text, config), at, session, order, timeout_s)
    df = analyse(df, [session, "episode"], [at, order], "heard")
    so_far = Window.partitionBy(session, "episode").orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"duration_us": F.unix_micros(at) - F.unix_micros(F.min(at).over(so_far)), "alert": F.col("risk_level") == "High"})


def stats(analysed: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """One row: sessions, those with a score, and those with a high one, by each session's last message."""
    last = analysed.groupBy(session).agg(F.max_by("escalation_score", order).alias("score"))
    return last.agg(F.count("*").alias("total_sessions"), F.count_if(F.col("score") > 0).alias("active_sessions"), F.count_if(F.col("score") >= HIGH_SCORE).alias("high_risk_sessions"))


def live(sessions: DataFrame, last_activity: str, now: Column, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """Sessions whose last activity, in epoch seconds, is less than the timeout ago."""
    return sessions.filter(now - F.col(last_activity) < timeout_s)
