"""Scan of raw text for bytes and markers that no clean prompt has; the first finding counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import contains_any

CONTROLS = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def finding(raw: Column) -> Column:
    """Detail of the first finding, or null."""
    control = F.regexp_extract(raw, f"({CONTROLS})", 1)
    return (
        F.when(F.contains(raw, F.lit("\0")), F.lit("raw null byte detected (SA-070)"))
        .when(control != "", F.concat(F.lit("raw control byte 0x"), F.lpad(F.hex(control), 2, "0"), F.lit(" detected (SA-070)")))
        .when(contains_any(ascii_lower(raw), V.PRESCAN_MARKERS), F.lit("injection marker detected at byte level (SA-070)"))
    )
