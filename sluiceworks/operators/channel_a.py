"""Channel A: structural checks, forbidden vocabularies under noise, then the ordered allowlist of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.patterns import ASKS, HEADS
from ..functions.screen import has
from ..functions.text import first_of, matches
from ..plans.config import GateConfig
from .decisions import fault, forbidden, malformed, passed, blocked, reason

DEADLINE_US = 50_000


def structural(screened: Column) -> Column:
    """The Block of the first structural fault of a screened prompt, or null."""
    text = screened["text"]
    return first_of(
        F.when(text.rlike(r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F\x80-\x9F]"), malformed("control character detected")),
        F.when(F.contains(text, F.lit("\0")), malformed("null byte in input")),
        F.when(screened["run"], malformed("repeated character run exceeds limit")),
        F.when(screened["has_obfuscation"], malformed("obfuscation characters detected")),
        F.when(screened["longest"] > V.MAX_TOKEN, malformed("token exceeds 512 chars")),
    )


def allowlist(screened: Column, config: GateConfig) -> Column:
    """The Pass of the first pattern that matches and whose guard finds nothing, or null.

    A pattern is only tried where one of its first words stands in the text, which costs a fraction of it."""
    rules, text = [], screened["text"]
    for name, intent, pattern, guard in V.PATTERNS:
        hit = F.endswith(text, F.lit("?")) if name in ASKS else F.lit(True)
        hit = (hit & has(screened, f"head_{name}") if name in HEADS else hit) & matches(text, pattern, config.ascii_words)
        rules.append(F.when(hit & ~has(screened, f"guard_{name[3:]}_a") if guard else hit, passed(intent)))
    rules += [F.when(matches(text, c.regex), passed(c.intent)) for c in config.intents]
    return first_of(*rules)


def evaluate(screened: Column, config: GateConfig, elapsed_us: Column | None = None) -> Column:
    """The decision of channel A on a screened prompt. elapsed_us, where given, stands for the watchdog's clock."""
    rules = [F.when(elapsed_us >= DEADLINE_US, fault("WatchdogFired"))] if elapsed_us is not None else []
    rules += [
        structural(screened),
        F.when(has(screened, "payload_a"), forbidden("FP-003-PAYLOAD")),
        F.when(has(screened, "markers_a"), forbidden("FP-006-INJECTION-MARKER")),
        F.when(has(screened, "sensitive_a"), forbidden("FP-004-SENSITIVE-TARGET")),
    ]
    if config.forbidden_keywords:
        rules.append(F.when(has(screened, "forbidden"), forbidden("CUSTOM-FORBIDDEN-KEYWORD")))
    return first_of(*rules, allowlist(screened, config), blocked(reason("NoIntentMatch")))
