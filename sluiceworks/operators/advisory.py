"""Channel C: a score of suspicion that never changes a verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.screen import has
from ..functions.text import starts_with_any


def points(screened: Column) -> dict[str, Column]:
    """What each heuristic adds, on a screened prompt."""
    text, low, n = screened["text"], screened["low"], F.length(screened["text"])
    yes = lambda cond, p: F.when(cond, p).otherwise(0)
    special = n - F.length(F.translate(text, V.ADVISORY_SPECIAL, ""))
    return {
        "special": yes((n > 0) & (special * 10 > n), 3),
        "imperative": yes(starts_with_any(low, V.IMPERATIVES), 3),
        "capitals": yes((screened["letters"] > 10) & (screened["capitals"] * 2 > screened["letters"]), 1),
        "encoded": yes(text.rlike(r"(^| )[A-Za-z0-9+/=]{20,}( |\z)"), 3),
        "indirection": yes(has(screened, "indirection"), 3),
        "persona": yes(has(screened, "persona"), 3),
        "negation": yes(has(screened, "negation"), 3),
        "payload": F.least(screened["nouns"], F.lit(3)),
    }


def score(screened: Column) -> Column:
    total = F.lit(0)
    for p in points(screened).values():
        total = total + p
    return total.cast("int")


def tag(points_: Column, kind: Column) -> Column:
    """Disagreement with a verdict that let a suspicious text pass."""
    hit = (points_ >= V.ADVISORY_LEAST) & kind.isin("Pass", "DiagnosticAgreement")
    return F.struct(F.when(hit, "Disagreement").otherwise("None").alias("type"), F.when(hit, points_).cast("int").alias("score"), F.when(hit, F.lit(V.ADVISORY_VERSION)).alias("heuristic_version"))
