"""Prompts on their one way through Python: normal form, lower case, sizes, and which keyword lists they touch."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .batches import judgeable, structs
from .keywords import BARE, NOISY, PLAIN, KeywordList, keywords
from .normalise import normalised
from .patterns import HEADS

#: Every list that a rule asks for, in the order of their bits, with how it is matched.
LISTS: dict[str, tuple[str, list[str]]] = {
    "payload_a": (NOISY, []), "markers_a": (NOISY, V.INJECTION_MARKERS), "sensitive_a": (NOISY, V.SENSITIVE_A), "forbidden": (PLAIN, []),
    "markers_b": (PLAIN, V.INJECTION_MARKERS), "hijack": (PLAIN, V.HIJACK_PHRASES), "payload_b": (BARE, []), "sensitive_b": (BARE, V.SENSITIVE_B),
    "guard_050_a": (PLAIN, V.GUARD_050_A), "guard_060_a": (PLAIN, V.GUARD_060_A), "guard_099_a": (PLAIN, V.GUARD_099_A), "guard_050_b": (PLAIN, V.GUARD_050_B), "guard_099_b": (PLAIN, V.GUARD_099_B),
    "indirection": (PLAIN, V.INDIRECTION), "persona": (PLAIN, V.PERSONA), "negation": (PLAIN, V.NEGATION), "nouns": (PLAIN, V.PAYLOAD_NOUNS),
    **{f"head_{name}": (PLAIN, words) for name, words in HEADS.items()},
}
BITS = {name: 1 << k for k, name in enumerate(LISTS)}
NOUNS = list(LISTS).index("nouns")
FIELDS = [
    ("text", pa.string()), ("low", pa.string()), ("words", pa.int32()), ("longest", pa.int32()), ("run", pa.bool_()), ("letters", pa.int32()), ("capitals", pa.int32()),
    ("has_obfuscation", pa.bool_()), ("too_long", pa.bool_()), ("hits", pa.int64()), ("nouns", pa.int32()),
]
SCREENED = "text string, low string, words int, longest int, run boolean, letters int, capitals int, has_obfuscation boolean, too_long boolean, hits long, nouns int"

_RUN = re.compile(rf"(.)\1{{{V.MAX_RUN}}}", re.DOTALL)
_NO_LETTERS, _CAPITAL = regex.compile(r"\P{Alphabetic}"), regex.compile(r"\p{Uppercase}")
_NO_LETTER, _NO_CAPITAL = (bytes(k for k in range(128) if not keep(chr(k))) for keep in (str.isalpha, str.isupper))


def lists_of(payload_a: Sequence[str], payload_b: Sequence[str], forbidden: Sequence[str] = ()) -> tuple[KeywordList, ...]:
    given = {"payload_a": payload_a, "payload_b": payload_b, "forbidden": [k.lower() for k in forbidden]}
    return tuple(KeywordList(name, how, tuple(given.get(name, words)), name == "nouns") for name, (how, words) in LISTS.items())


def has_run(text: str) -> bool:
    """Whether a character is repeated over MAX_RUN times in a row: such a run fills the space between two marks half of MAX_RUN apart."""
    step = V.MAX_RUN // 2
    for at in range(0, len(text) - step, step):
        c = text[at]
        if c == text[at + step] and text[at : at + step] == c * step:
            return bool(_RUN.search(text))
    return False


def longest_word(text: str) -> int:
    """The length of the longest word if that is over MAX_TOKEN, else some number up to it."""
    at = 0
    while len(text) - at > V.MAX_TOKEN:
        blank = text.rfind(" ", at, at + V.MAX_TOKEN + 1)
        if blank < 0:
            return max(map(len, text.split(" ")))
        at = blank + 1
    return len(text) - at


def cased(text: str) -> tuple[int, int]:
    """Letters and capital letters of a text."""
    if text.isascii():
        return tuple(len(text.encode().translate(None, drop)) for drop in (_NO_LETTER, _NO_CAPITAL))
    return len(text) - len(_NO_LETTERS.findall(text)), len(_CAPITAL.findall(text))


def screened_one(raw: str | None, lists: tuple[KeywordList, ...]) -> tuple:
    """The fields of one prompt; all null but the flags where there is no text to judge."""
    text, dropped, too_long = normalised(raw)
    if text is None:
        return *[None] * 7, dropped, too_long, None, None
    low = text.lower()
    found = keywords(lists).found(low)
    letters, capitals = cased(text)
    return text, low, text.count(" ") + 1 if text else 0, longest_word(text), has_run(text), letters, capitals, dropped, False, sum(bit for bit, x in zip(BITS.values(), found, strict=True) if x), len(found[NOUNS])


def screen(text: Column, payload_a: Sequence[str], payload_b: Sequence[str], forbidden: Sequence[str] = ()) -> Column:
    """STRUCT<SCREENED> of each prompt: `longest` is its longest word's length if that is over MAX_TOKEN, else some number up to it, `hits` has a
    bit for each list with a keyword in the text (`has`), `nouns` counts the payload nouns of the advisory."""
    lists = lists_of(payload_a, payload_b, forbidden)

    @F.arrow_udf(SCREENED)
    def run(raw: pa.Array) -> pa.Array:
        return structs(raw, lambda x: screened_one(x, lists), FIELDS)

    # As one that may differ each time it is run once: a filter on a field would run it a second time, in a second worker.
    return run.asNondeterministic()(judgeable(text))


def has(screened: Column, name: str) -> Column:
    """Whether a screened prompt has a keyword of the list."""
    return screened["hits"].bitwiseAND(F.lit(BITS[name])) != 0
