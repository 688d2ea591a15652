"""The vote of two channels, the profile filter, and the reason that a verdict carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import literals
from .decisions import blocked, reason


def decide(a: Column, b: Column) -> Column:
    """A fault or two blocks block; two passes agree or differ on the intent; else the channels disagree."""
    x, y = a["type"], b["type"]
    return (
        F.when((x == "Fault") | (y == "Fault"), "Block")
        .when((x == "Block") & (y == "Block"), "Block")
        .when((x == "Pass") & (y == "Pass"), F.when(a["intent"] == b["intent"], "Pass").otherwise("DiagnosticAgreement"))
        .otherwise("DiagnosticDisagreement")
    )


def prohibited(kind: Column, a: Column, b: Column, profile: str | None) -> Column:
    """The intent that the profile does not permit, or null. Channel A's intent is looked at first."""
    permitted = V.PROFILES.get(profile or "")
    intent = F.coalesce(a["intent"], b["intent"])
    if permitted is None:
        return F.lit(None).cast("string")
    return F.when(kind.isin("Pass", "DiagnosticAgreement") & ~F.array_contains(literals(permitted), intent), intent)


def under_profile(decision: Column, intent: Column) -> Column:
    return F.when(intent.isNotNull(), blocked(reason("ProhibitedIntent", intent=intent))).otherwise(decision)


def block_reason(kind: Column, a: Column, b: Column) -> Column:
    """Nothing for what passes; else A's reason, or B's where A has none."""
    return F.when(~kind.isin("Pass", "DiagnosticAgreement"), F.coalesce(a["reason"], b["reason"]))
