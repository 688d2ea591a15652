"""Screening of responses: prompt leakage, personal data, encoded payloads and framing, voted one out of two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions import windows
from ..functions.text import contains_any, first_of
from .decisions import forbidden, malformed, passed


def leaked(prompt: Column, response: Column) -> Column:
    """The first stretch of the prompt that the response repeats, or null; both normalised. Windows count characters."""
    return windows.leaked(prompt, response)


def pii(text: Column) -> Column:
    """The kind of the first pattern that raw text matches, or null."""
    return first_of(*[F.when(text.rlike("(?U)" + p), F.lit(n)) for n, p in V.PII])


def encoded(text: Column) -> Column:
    """Whether nearly all of a longer text is of the base64 alphabet."""
    n, size = F.length(F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")), F.octet_length(text)
    return (n > 64) & (size > 64) & (n.cast("float") / size.cast("float") > 0.9)


def framing(text: Column) -> Column:
    """Id of the first framing phrase, or null."""
    low = F.lower(text)
    return first_of(*[F.when(F.contains(low, F.lit(p)), F.lit("EGRESS-RE-001-" + p.replace(" ", "-").upper())) for p in V.FRAMING])


def channel_e(prompt: Column, response: Column, normalised_response: Column) -> Column:
    leak, kind = leaked(prompt, normalised_response), pii(response)
    return first_of(
        F.when(leak.isNotNull(), malformed(F.concat(F.lit("Potential system prompt leakage: "), leak))),
        F.when(kind.isNotNull(), malformed(F.concat(F.lit("PII detected: "), kind))),
        passed("ConversationalAcknowledgement"),
    )


def channel_f(response: Column) -> Column:
    phrase = framing(response)
    return first_of(
        F.when(encoded(response), malformed("Obfuscated/Encoded data detected: Potential Base64/Encoded data")),
        F.when(phrase.isNotNull(), forbidden(phrase)),
        passed("ConversationalAcknowledgement"),
    )


def vote(e: Column, f: Column) -> Column:
    return F.when((e["type"] == "Pass") & (f["type"] == "Pass"), "Pass").otherwise("EgressBlock")


def egress_reason(e: Column, f: Column) -> Column:
    """STRUCT<type, detail> of the channel that blocks, E first; null if neither does."""
    why = F.when(e["type"] == "Block", e["reason"]).when(f["type"] == "Block", f["reason"])
    kind = (
        F.when((why["type"] == "MalformedInput") & F.startswith(why["detail"], F.lit("PII")), "PiiDetected")
        .when(why["type"] == "MalformedInput", "SystemPromptLeakage")
        .when(why["type"] == "ForbiddenPattern", "HarmfulContent")
        .otherwise("Other")
    )
    return F.when(why.isNotNull(), F.struct(kind.alias("type"), F.coalesce(why["detail"], why["pattern_id"]).alias("detail")))


def shown(reason: Column) -> Column:
    """The reason as one line."""
    title = F.when(reason["type"] == "SystemPromptLeakage", "System Prompt Leakage").when(reason["type"] == "PiiDetected", "PII Detected").when(reason["type"] == "HarmfulContent", "Harmful Content").otherwise("Egress Block")
    return F.when(reason.isNotNull(), F.concat_ws(": ", title, reason["detail"]))


def framed(text: Column) -> Column:
    return contains_any(F.lower(text), V.FRAMING)
