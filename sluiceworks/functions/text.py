"""Column helpers for rules over text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word's bound as RE2 has it: only ASCII letters, digits and the underscore belong to words.
ASCII_BOUND = "(?-i:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(text: Column, then: Callable[[Column], Column]) -> Column:
    """then(text) with the text computed once a row: inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(text), then), 0)


def contains_any(text: Column, values: list[str]) -> Column:
    return once(text, lambda t: F.exists(literals(values), lambda v: F.contains(t, v)))


def has_any(text: Column, values: list[str]) -> Column:
    """contains_any for a text that is a column as it stands, so that nothing is computed again for each value."""
    hit = F.lit(False)
    for v in values:
        hit = hit | F.contains(text, F.lit(v))
    return hit


def starts_with_any(text: Column, values: list[str]) -> Column:
    return once(text, lambda t: F.exists(literals(values), lambda v: F.startswith(t, v)))


def matches(text: Column, pattern: str, ascii_words: bool = False) -> Column:
    """A Unicode pattern in which a dot stops at line feeds only; with ascii_words its word bounds are ASCII_BOUND."""
    return text.rlike("(?iuUd)" + (pattern.replace(r"\b", ASCII_BOUND) if ascii_words else pattern))


def first_of(*rules: Column) -> Column:
    return F.coalesce(*rules)
