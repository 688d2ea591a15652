"""The gate as plans: prompts to verdicts, pairs of prompt and response to egress verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import normalise
from ..functions.screen import screen
from ..operators import advisory, channel_a, channel_b, egress, prescan, voter
from ..operators.decisions import blocked, label, malformed, reason
from .config import GateConfig


def screened(text: Column, config: GateConfig) -> Column:
    """What both channels and the advisory read of a prompt."""
    return screen(text, config.payload_a, config.payload_b, config.forbidden_keywords)


def verdicts(prompts: DataFrame, text: str = "text", config: GateConfig | None = None, raw: bool = True) -> DataFrame:
    """prompts with verdict_kind, is_pass, channel_a, channel_b, block_reason, input_hash, advisory and normalised.

    raw=False leaves out the byte scan, for text that was normalised before. Null texts are blocked as malformed.
    """
    config = config or GateConfig()
    df = prompts.withColumn("_n", screened(F.col(text), config))
    df = df.withColumns({"normalised": F.col("_n.text"), "_found": prescan.finding(F.col(text)) if raw else F.lit(None).cast("string")})
    n = F.col("_n")
    early = F.coalesce(
        F.when(F.col(text).isNull(), malformed("null input")),
        F.when(F.col("_found").isNotNull(), malformed(F.col("_found"))),
        F.when(F.col("_n.too_long"), blocked(reason("ExceededMaxLength"))),
    )
    df = df.withColumn("_early", early)
    df = df.withColumns({"_a": F.coalesce("_early", channel_a.evaluate(n, config)), "_b": F.coalesce("_early", channel_b.evaluate(n, config))})
    df = df.withColumn("_kind", voter.decide(F.col("_a"), F.col("_b")))
    df = df.withColumn("_not", voter.prohibited(F.col("_kind"), F.col("_a"), F.col("_b"), config.profile))
    df = df.withColumns(
        {
            "verdict_kind": F.when(F.col("_not").isNotNull(), "Block").otherwise(F.col("_kind")),
            "channel_a": voter.under_profile(F.col("_a"), F.col("_not")),
            "channel_b": voter.under_profile(F.col("_b"), F.col("_not")),
        }
    )
    df = df.withColumns(
        {
            "is_pass": F.col("verdict_kind").isin("Pass", "DiagnosticAgreement"),
            "block_reason": voter.block_reason(F.col("verdict_kind"), F.col("channel_a"), F.col("channel_b")),
            "input_hash": F.sha2(F.when(F.col("_early").isNull(), F.col("normalised")).otherwise(F.col(text)), 256),
            "advisory": advisory.tag(F.coalesce(advisory.score(n), F.lit(0)), F.col("verdict_kind")),
            "early": F.col("_early").isNotNull(),
        }
    )
    return df.drop("_n", "_found", "_early", "_a", "_b", "_kind", "_not")


def labelled(df: DataFrame) -> DataFrame:
    """verdicts with both channels and the reason as strings."""
    return df.withColumns({"a": label(F.col("channel_a")), "b": label(F.col("channel_b")), "reason": F.concat_ws(":", "block_reason.type", F.coalesce("block_reason.pattern_id", "block_reason.detail", "block_reason.intent"))})


def egress_verdicts(pairs: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """pairs with egress_kind, egress_reason, the reason's text, and the hash of the normalised prompt.

    Leakage is looked for in the normalised response, by stretches of the normalised prompt; a prompt that is too long has none."""
    df = pairs.withColumns({"_p": normalise(F.col(prompt))["text"], "_r": normalise(F.col(response))["text"]})
    df = df.withColumns({"_e": egress.channel_e(F.col("_p"), F.col(response), F.col("_r")), "_f": egress.channel_f(F.col(response))})
    df = df.withColumns({"egress_kind": egress.vote(F.col("_e"), F.col("_f")), "egress_reason": egress.egress_reason(F.col("_e"), F.col("_f"))})
    return df.withColumns({"egress_text": egress.shown(F.col("egress_reason")), "input_hash": F.sha2(F.coalesce("_p", prompt), 256)}).drop("_p", "_r", "_e", "_f")
