"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Texts are lower-cased (A-Z) and read as words of letters, digits and anything beyond ASCII; a phrase stands where its words
stand in a row, whatever is between them. Behind an identifier tag, or words such as "licensed under", the longest valid
expression of the line is parsed: `and` keeps the least of two values, `or` the greatest, `with` lifts a copyleft licence
to WITH_EXCEPTION. A value says how freely the text may be used, from 0 (all rights reserved) to 1 (public domain). All that a
document states applies together, so its score is the least value; UNSTATED where nothing is stated. A phrase inside
a longer one ("cc by" in "cc by nc") is counted and named, but only the longer one has a say in the score.

Null and empty texts have no words and no findings. Very long texts are searched whole, in overlapping segments; what is kept
of a document is a row for each label, however often it occurs. Repeated rows get equal results, a null id stays null, an
empty table gives no rows, and columns besides the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import chunks, utf8

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: How freely what each licence covers may be used.
VALUES = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "zlib": 0.9, "boost": 0.9, "apache": 0.9, "python": 0.9, "cc-by": 0.9,
    "artistic": 0.7, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gfdl": 0.5, "gpl": 0.4, "eupl": 0.4, "agpl": 0.3,
    "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nd": 0.2, "cc-by-nc-nd": 0.1, "proprietary": 0.0, "reserved": 0.0,
}
UNSTATED, UNKNOWN, WITH_EXCEPTION = 0.5, 0.5, 0.6

#: Notice phrases beside the base ones, as words.
NOTICES = {
    "mit license": "mit", "mit licence": "mit", "expat license": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "bsd license": "bsd", "bsd licence": "bsd", "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc", "permission to use copy modify and or distribute this software for any purpose": "isc",
    "apache license": "apache", "apache licence": "apache", "apache software license": "apache", "boost software license": "boost", "zlib license": "zlib", "python software foundation license": "python",
    "artistic license": "artistic", "mozilla public license": "mpl", "eclipse public license": "epl", "common development and distribution license": "cddl", "european union public licence": "eupl",
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl", "gnu free documentation license": "gfdl", "gnu general public licence": "gpl",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0", "creative commons zero": "cc0", "dedicated to the public domain": "public-domain", "released into the public domain": "public-domain", "this is free and unencumbered software": "unlicense",
    "proprietary and confidential": "proprietary", "no part of this publication may be reproduced": "reserved", "alle rechte vorbehalten": "reserved", "tous droits réservés": "reserved", "todos los derechos reservados": "reserved",
}
#: Behind these an expression is expected; with False only of licences that are known, since prose may follow.
TAGS = {"spdx license identifier": True, "license expression": True, "licensed under": False, "licenced under": False, "released under": False, "available under": False, "distributed under": False}

#: Beginnings of identifiers and the label they stand for; the first that fits counts.
IDENTIFIERS = [
    ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("gfdl", "gfdl"), ("apache", "apache"), ("mit-0", "mit"), ("mit", "mit"), ("expat", "mit"), ("0bsd", "0bsd"), ("bsd", "bsd"), ("isc", "isc"), ("zlib", "zlib"), ("bsl", "boost"),
    ("mpl", "mpl"), ("epl", "epl"), ("eupl", "eupl"), ("cddl", "cddl"), ("artistic", "artistic"), ("psf", "python"), ("python", "python"), ("unlicense", "unlicense"), ("cc0", "cc0"),
    ("cc-by-nc-nd", "cc-by-nc-nd"), ("cc-by-nc-sa", "cc-by-nc-sa"), ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"),
]
POWER = {"or": 1, "and": 2, "with": 3}

_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_LEAD = re.compile(rb"[ \t:=\"']*(?:(?:the|a|an|terms|of|either)[ \t]+)*", re.IGNORECASE)


def known(identifier: str) -> str | None:
    """The label of a licence's identifier, in any version, or None."""
    low = identifier.lower()
    return next((label for start, label in IDENTIFIERS if low == start or (low.startswith(start) and not low[len(start)].isalpha())), None)


def _tokens(raw: bytes, at: int, line: int, every: bool) -> tuple[list[str], int]:
    """The longest valid expression from `at` to the end of its line, and where it ends; operands are any names, or known licences only."""
    at = _LEAD.match(raw, at, line).end()
    found, best, end, depth, operand = [], 0, at, 0, True
    while m := _TOKEN.match(raw, at, line):
        token = m.group(1).decode().rstrip(".:")
        low = token.lower()
        if operand and token == "(" and not (found and found[-1].lower() == "with"):
            depth += 1
        elif operand and token not in ("(", ")") and low not in POWER and (every or known(token) or (found and found[-1].lower() == "with")):
            operand = False
        elif not operand and token == ")" and depth:
            depth -= 1
        elif not operand and low in POWER and (low != "with" or found[-1] != ")"):
            operand = True
        else:
            break
        found.append(token)
        at = m.end()
        if not operand and not depth:
            best, end = len(found), at
        if len(token) < len(m.group(1)):  # a full stop ends the sentence
            break
    return found[:best], end


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands in their order, each operator behind what it joins; `with` binds closest, then `and`, then `or`."""
    out, held = [], []
    for token in tokens:
        low = token.lower()
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif low in POWER:
            while held and held[-1] != "(" and POWER[held[-1]] >= POWER[low]:
                out.append(held.pop())
            held.append(low)
        else:
            out.append(token)
    return out + held[::-1]


def evaluated(tokens: list[str]) -> tuple[float, set[str]]:
    """The value of a valid expression and the labels of its licences; names that are not known stand for themselves."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix(tokens):
        if token in POWER:
            (b, right), (a, left) = stack.pop(), stack.pop()
            stack.append((max(a, WITH_EXCEPTION), left) if token == "with" else ((min if token == "and" else max)(a, b), left | right))
        else:
            label = known(token) or token.lower()
            stack.append((VALUES.get(label, UNKNOWN), {label}))
    return stack[0]


def expression(text: str) -> tuple[float, set[str]] | None:
    """Value and labels of a whole licence expression; None where it is not valid."""
    raw = text.strip().encode()
    tokens, end = _tokens(raw, 0, len(raw), True)
    return evaluated(tokens) if tokens and end == len(raw) else None


@dataclass(frozen=True)
class Patterns:
    """The phrases of a table as one automaton; kind is 'base', 'notice' or 'tag'."""

    words: list[str]
    kind: list[str]
    label: list[str]
    automaton: ahocorasick.Automaton
    longest: int


@lru_cache(maxsize=1)
def patterns() -> Patterns:
    rows = [(w, "base", x) for w, x in BASE.items()] + [(w, "notice", x) for w, x in NOTICES.items()] + [(w, "tag", "") for w in TAGS]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, (words, _, _) in enumerate(rows):
        automaton.add_word(f" {words} ".encode().decode("latin-1"), k)
    automaton.make_automaton()
    return Patterns(*(list(x) for x in zip(*rows, strict=True)), automaton, max(len(w.encode()) for w, _, _ in rows) + 2)


#: Lower case of every byte of a word, a blank for every other.
_READ = np.full(256, 32, dtype=np.uint8)
_READ[48:58] = np.arange(48, 58)
_READ[97:123] = np.arange(97, 123)
_READ[65:91] = np.arange(97, 123)
_READ[128:] = np.arange(128, 256)
#: Bytes searched at once, and hits turned into arrays at once.
SEGMENT, HITS = 1 << 20, 1 << 16


def hits(plain: np.ndarray, table: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(end, pattern) of every occurrence in words with one blank between and around them; ends are exclusive."""
    size = np.array([len(w.encode()) + 2 for w in table.words])
    found = []
    for base in range(0, len(plain), SEGMENT):
        part = plain[base : base + SEGMENT + table.longest - 1].tobytes().decode("latin-1")
        stream = table.automaton.iter(part)
        while some := list(islice(stream, HITS)):
            one = np.array(some, dtype=np.int64).reshape(-1, 2)
            one = one[one[:, 0] + 1 - size[one[:, 1]] < SEGMENT]  # the next segment has the others
            found.append(one + [base + 1, 0])
    rows = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return rows[:, 0], rows[:, 1]


@dataclass
class Found:
    """Occurrences in a batch of texts, in order: text, pattern, first word in its text, bytes from start to end, and whether a longer one holds it."""

    n_words: np.ndarray
    text: np.ndarray
    pattern: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    inside: np.ndarray


def search(data: np.ndarray, offsets: np.ndarray, table: Patterns) -> Found:
    """All occurrences in the texts that lie end to end in `data`."""
    # Between texts goes a line feed with a blank on both sides: no phrase holds one.
    cut = np.repeat(offsets[1:-1], 3)
    plain = np.insert(_READ[data], cut, np.tile(np.frombuffer(b" \n ", np.uint8), len(offsets) - 2)) if len(offsets) > 2 else _READ[data]
    plain = np.concatenate([[32], plain, [32]]).astype(np.uint8)
    blank = plain == 32
    double = np.append(False, blank[1:] & blank[:-1])
    plain = plain[~double]
    blank = plain == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:] & (plain[1:] != 10)) + 1  # of words, in `plain`
    breaks = np.append(np.flatnonzero(plain == 10), len(plain))
    upto = np.searchsorted(starts, breaks)
    before = np.append(0, upto[:-1])
    raw = _READ[data] != 32
    first, last = raw.copy(), raw.copy()
    first[1:] &= ~raw[:-1]
    last[:-1] &= ~raw[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge], last[edge - 1] = raw[edge], raw[edge - 1]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1  # of the same words, in `data`
    end, pattern = hits(plain, table)
    lengths = np.array([len(w.encode()) + 2 for w in table.words])[pattern]
    count = np.array([len(w.split()) for w in table.words])[pattern]
    by = np.lexsort((-end, end - lengths))
    end, pattern, lengths, count = end[by], pattern[by], lengths[by], count[by]
    word = np.searchsorted(starts, end - lengths + 1)
    text = np.searchsorted(upto, word, side="right")
    speaks = ~np.array([k == "tag" for k in table.kind])[pattern]
    reach = np.maximum.accumulate(np.where(speaks, end, 0)) if len(end) else end
    inside = np.append(False, end[1:] <= reach[:-1]) if len(end) else np.zeros(0, bool)
    return Found(upto - before, text, pattern, word - before[text], begin[word], stop[word + count - 1], inside)


def _expressions(found: Found, data: np.ndarray, offsets: np.ndarray, table: Patterns) -> Iterator[tuple[int, int, int, int, str, float, set[str]]]:
    """(text, word of its tag, start, end, expression, value, labels) of each expression behind a tag; places are bytes of `data`."""
    tags = np.flatnonzero(np.array([k == "tag" for k in table.kind])[found.pattern])
    if not len(tags):
        return
    raw, breaks = data.tobytes(), np.append(np.flatnonzero(data == 10), len(data))
    lines = np.minimum(breaks[np.searchsorted(breaks, found.end[tags])], offsets[found.text[tags] + 1])
    for k, line in zip(tags.tolist(), lines.tolist(), strict=True):
        tokens, end = _tokens(raw, int(found.end[k]), line, TAGS[table.words[found.pattern[k]]])
        if tokens:
            yield int(found.text[k]), int(found.word[k]), int(found.start[k]), end, " ".join(tokens), *evaluated(tokens)


PLACE = "doc_id long, kind string, label string, word long, start long, end long, expression string, value double"
FINDING = "label string, kind string, places long, first_word long, last_word long, value double"


def _picked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def license_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each place: its kind (base, notice or expression), label, first word, bytes, and for an expression its tokens; value is null inside a longer phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = patterns()
        for batch in chunks(batches, "text", SEGMENT):
            data, offsets = utf8(batch.column("text"))
            ids, found = batch.column("doc_id").to_pylist(), search(data, offsets, table)
            rows = []
            for t, p, w, a, b, hidden in zip(*(x.tolist() for x in (found.text, found.pattern, found.word, found.start, found.end, found.inside)), strict=True):
                if table.kind[p] != "tag":
                    rows.append((ids[t], table.kind[p], table.label[p], w, a - int(offsets[t]), b - int(offsets[t]), None, None if hidden else VALUES[table.label[p]]))
            for t, w, a, b, shown, value, labels in _expressions(found, data, offsets, table):
                rows += [(ids[t], "expression", x, w, a - int(offsets[t]), b - int(offsets[t]), shown, value) for x in sorted(labels)]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PLACE.split(", ")])

    return _picked(docs, doc_id, text).mapInArrow(run, PLACE)


def license_findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: n_words and its findings, one for each kind and label, with how many places and the least value."""
    finding = pa.struct([("label", pa.string()), ("kind", pa.string()), ("places", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = patterns()
        tag = np.array([k == "tag" for k in table.kind])
        for batch in chunks(batches, "text", SEGMENT):
            data, offsets = utf8(batch.column("text"))
            found = search(data, offsets, table)
            held: list[dict[tuple[str, str], list]] = [{} for _ in range(batch.num_rows)]

            def add(text: int, kind: str, label: str, places: int, first: int, last: int, value: float | None) -> None:
                row = held[text].setdefault((label, kind), [0, first, last, None])  # noqa: B023
                row[0], row[1], row[2] = row[0] + places, min(row[1], first), max(row[2], last)
                if value is not None:
                    row[3] = value if row[3] is None else min(row[3], value)

            speaks = np.flatnonzero(~tag[found.pattern])
            key = found.text[speaks] * (2 * len(tag)) + found.pattern[speaks] * 2 + found.inside[speaks]
            groups, at, size = np.unique(key, return_index=True, return_counts=True)
            order = np.argsort(key, kind="stable")
            final = order[np.cumsum(size) - 1] if len(groups) else at
            for g, a, z, n in zip(groups.tolist(), at.tolist(), final.tolist(), size.tolist(), strict=True):
                text, p, hidden = g // (2 * len(tag)), g // 2 % len(tag), g % 2
                add(text, table.kind[p], table.label[p], n, int(found.word[speaks[a]]), int(found.word[speaks[z]]), None if hidden else VALUES[table.label[p]])
            for text, word, _, _, _, value, labels in _expressions(found, data, offsets, table):
                for label in labels:
                    add(text, "expression", label, 1, word, word, value)
            rows = [[{"label": x, "kind": k, "places": r[0], "first_word": r[1], "last_word": r[2], "value": r[3]} for (x, k), r in sorted(one.items())] for one in held]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.n_words, pa.int64()), pa.array(rows, pa.list_(finding))], ["doc_id", "n_words", "findings"])

    return _picked(docs, doc_id, text).mapInArrow(run, f"doc_id long, n_words long, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")


def _joined(findings: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(findings, lambda x: x["label"]))))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document n_words, the base places and labels, all labels, and the score."""
    base = F.filter("findings", lambda x: x["kind"] == "base")
    value = F.array_min(F.transform("findings", lambda x: x["value"]))
    return license_findings(docs, doc_id, text).select(
        "doc_id", "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda a, x: a + x["places"]).alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["last_word"])).alias("last_word"),
        _joined(base).alias("base_labels"), _joined(F.col("findings")).alias("labels"), F.coalesce(value, F.lit(UNSTATED)).alias("score"),
    )
