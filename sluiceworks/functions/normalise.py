"""Prompt normalisation, the one step that needs Python: Spark has no Unicode normal forms."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V
from .batches import judgeable, slices, structs

SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("has_obfuscation", T.BooleanType()), T.StructField("too_long", T.BooleanType())])
FIELDS = [("text", pa.string()), ("has_obfuscation", pa.bool_()), ("too_long", pa.bool_())]


def _set(ranges: list[tuple[int, int]]) -> re.Pattern[str]:
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")


OBFUSCATION, COMBINING = _set(V.OBFUSCATION), _set(V.COMBINING)
#: Whether neither class has a character of ASCII.
PLAIN = not any(p.search(chr(c)) for p in (OBFUSCATION, COMBINING) for c in range(128))
LOOKALIKES = {a: b for keys, values in V.LOOKALIKES.items() for a, b in zip(keys, values, strict=True)}
_LOOKALIKE = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
#: White space as Unicode defines it; Python's own class also has U+001C to U+001F.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SIGNS = re.escape(V.SEPARATORS)
#: A whole run of letters, digits and separators with over three separators; other runs stay as they are.
_SEPARATED = re.compile(f"(?<![0-9A-Za-z{_SIGNS}])(?:[0-9A-Za-z]*+[{_SIGNS}]){{4}}[0-9A-Za-z{_SIGNS}]*")
_SEPARATOR = re.compile(f"(?<=[0-9A-Za-z])[{_SIGNS}](?=[0-9A-Za-z])")
_SEGMENT = re.compile("[0-9A-Za-z]+")
_LEADING = tuple(phrase for phrase, _ in V.LEADING)
LEAD = max(map(len, _LEADING))
REACH = 8


def without_separators(text: str) -> str:
    """Drop a separator inside a word when, within REACH characters to either side, over four parts are set apart by over three separators."""

    def stretch(run: re.Match[str]) -> str:
        whole = run.group()

        def one(sep: re.Match[str]) -> str:
            near = whole[max(sep.start() - REACH, 0) : sep.start() + REACH + 1]
            parts = len(_SEGMENT.findall(near))
            return "" if parts > 4 and sum(c in V.SEPARATORS for c in near) > 3 else sep.group()

        return _SEPARATOR.sub(one, whole)

    return _SEPARATED.sub(stretch, text)


def folded(raw: str | None) -> tuple[str | None, bool, bool]:
    """normalised(raw) before a leading phrase is read in English; only the input's size is looked at."""
    if raw is None:
        return None, False, False
    text = raw.replace("\r\n", "\n").replace("\r", "\n")
    if len(text.encode()) > V.MAX_BYTES:
        return None, False, True
    if text.isascii() and PLAIN:  # no normal form changes it
        dropped = 0
    else:
        text = unicodedata.normalize("NFKC", text)
        text, dropped = OBFUSCATION.subn("", unicodedata.normalize("NFD", text))
        text = unicodedata.normalize("NFC", COMBINING.sub("", text))
    text = without_separators(_LOOKALIKE.sub(lambda m: LOOKALIKES[m.group()], text))
    # Python's split() is faster, but it also takes four control characters as white space.
    text = BLANKS.sub(" ", text).strip(" ") if any(c in text for c in "\x1c\x1d\x1e\x1f") else " ".join(text.split())
    return text, bool(dropped), False


def normalised(raw: str | None) -> tuple[str | None, bool, bool]:
    """(text, has_obfuscation, too_long); the text is None where it is too long, or the input was."""
    text, dropped, too_long = folded(raw)
    if text is None:
        return None, dropped, too_long
    low = text[:LEAD].lower()
    if low.startswith(_LEADING):
        phrase, reading = next(x for x in V.LEADING if low.startswith(x[0]))
        text = reading + text[len(phrase) :]
    if len(text.encode()) > V.MAX_BYTES:
        return None, dropped, True
    return text, dropped, False


@F.arrow_udf(SCHEMA)
def _normalise(raw: pa.Array) -> pa.Array:
    return structs(raw, normalised, FIELDS)


@F.arrow_udf(T.StringType())
def _fold(raw: pa.Array) -> pa.Array:
    return pa.array((folded(x)[0] for (x,) in slices(raw)), pa.string())


def normalise(raw: Column | str) -> Column:
    """STRUCT<text, has_obfuscation, too_long> of each text."""
    return _normalise(judgeable(raw))


def fold(raw: Column | str) -> Column:
    """The folded text of each text; null where that is too long."""
    return _fold(judgeable(raw))
