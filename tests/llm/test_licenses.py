import itertools
import random
import re

import pytest

from sluiceworks.llm import license_scan as scan

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    """(n_words, places, first, last, labels) by comparing every word with every phrase."""
    words = WORD.findall(lowered(text))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def rows():
    r = random.Random(8)
    parts = ["cc", "BY", "cc by", "CC-BY-NC 4.0", "general", "public\n", "license", "General Public License", "all rights reserved.", "é", "x", "Lesser", "MIT License", "under", "Licensed under the", "!", "  ", "\0", "İ", "SPDX-License-Identifier:", "mit or gpl", "reserved"]
    out = [(k, r.choice([" ", "-", "/ ", "\n"]).join(r.choice(parts) for _ in range(r.randint(0, 30)))) for k in range(400)]
    out += [(500, None), (501, ""), (502, " \n"), (503, "cc by " * 60_000), (504, "cc\x7fby"), (505, "ccéby cc by"), (506, "all rights" + " " * 3000 + "reserved"), (None, "cc by"), (7, "CC BY"), (7, "CC BY"), (507, "public license"), (508, "general")]
    return out


def test_base_columns_equal_a_search_of_every_word(spark):
    data = rows()
    out = scan.license_scan(cases.wide(spark, data)).collect()
    assert len(out) == len(data)
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out)
    want = [(d is None, d, *base(t)) for d, t in data]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all(0 <= r.score <= 1 for r in out)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out if r.base_labels)


def test_all_phrases_equal_a_plain_search(spark):
    table = scan.patterns()
    data = rows()
    got = {}
    for r in scan.license_places(cases.frame(spark, data)).filter("kind <> 'expression' AND doc_id IS NOT NULL AND doc_id <> 7").collect():
        got.setdefault(r.doc_id, set()).add((r.word, r.label, r.kind))
        text = dict(data)[r.doc_id].encode()[r.start : r.end].decode()
        assert " ".join(WORD.findall(lowered(text))) in table.words
    for d, t in data:
        if d in (None, 7):
            continue
        words = WORD.findall(lowered(t))
        want = set()
        for p, kind, label in zip(table.words, table.kind, table.label, strict=True):
            p = p.split()
            if kind != "tag":
                want |= {(i, label, kind) for i in range(len(words)) if words[i] == p[0] and words[i : i + len(p)] == p}
        assert got.get(d, set()) == want


def test_hits_at_the_seams_of_segments(monkeypatch):
    import numpy as np

    table = scan.patterns()
    plain = np.frombuffer((" cc by nc sa all rights reserved " * 9).replace("  ", " ").encode(), np.uint8)
    whole = set(zip(*(x.tolist() for x in scan.hits(plain, table)), strict=True))
    for size in (1, 7, 64, 65, 100):
        monkeypatch.setattr(scan, "SEGMENT", size)
        ends, kinds = scan.hits(plain, table)
        assert len(ends) == len(whole) and set(zip(ends.tolist(), kinds.tolist(), strict=True)) == whole


@pytest.mark.parametrize(
    ("text", "value", "labels"),
    [
        ("MIT", 0.9, {"mit"}),
        ("MIT OR GPL-2.0-only", 0.9, {"mit", "gpl"}),
        ("MIT AND GPL-2.0-only", 0.4, {"mit", "gpl"}),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", 0.6, {"gpl"}),
        ("MIT AND GPL-3.0+ OR CC0-1.0 AND AGPL-3.0", 0.4, {"mit", "gpl", "cc0", "agpl"}),
        ("MIT AND (AGPL-3.0 OR CC0-1.0)", 0.9, {"mit", "agpl", "cc0"}),
        ("(((LGPL-2.1)))", 0.6, {"lgpl"}),
        ("LicenseRef-Own", 0.5, {"licenseref-own"}),
        ("Apache-2.0 WITH LLVM-exception OR MIT", 0.9, {"apache", "mit"}),
    ],
)
def test_expressions(text, value, labels):
    assert scan.expression(text) == (value, labels)


@pytest.mark.parametrize("text", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT GPL", "MIT WITH", "MIT WITH (X)", "(MIT OR GPL) WITH X", "()", "OR"])
def test_what_is_no_expression(text):
    assert scan.expression(text) is None


def test_postfix_equals_a_recursive_reading():
    """Every expression of up to four operands and one pair of brackets, against splitting at the weakest operator."""

    def read(tokens):
        if len(tokens) == 1:
            return scan.VALUES[tokens[0]]
        depth, cuts = 0, {"or": [], "and": []}
        for k, t in enumerate(tokens):
            depth += (t == "(") - (t == ")")
            if not depth and t in cuts:
                cuts[t].append(k)
        for op, join in (("or", max), ("and", min)):
            if cuts[op]:
                k = cuts[op][-1]
                return join(read(tokens[:k]), read(tokens[k + 1 :]))
        return read(tokens[1:-1])

    names = ["mit", "gpl", "agpl", "cc0"]
    for n in (2, 3, 4):
        for ops in itertools.product(["and", "or"], repeat=n - 1):
            plain = [x for pair in itertools.zip_longest(names[:n], ops) for x in pair if x]
            for a in range(n):
                for b in range(a + 1, n):
                    tokens = [*plain[: 2 * a], "(", *plain[2 * a : 2 * b + 1], ")", *plain[2 * b + 1 :]]
                    assert scan.evaluated(tokens)[0] == read(tokens)


def test_scores(spark):
    texts = ["nothing here", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.",
             "/* SPDX-License-Identifier: MIT OR GPL-2.0 */", "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note\nand more text", "GNU Lesser General Public License", "licensed under many names", "Licensed under (MIT OR\nGPL-2.0)"]
    got = {r.doc_id: (r.score, r.labels) for r in scan.license_scan(cases.wide(spark, list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == [
        (0.5, ""), (0.9, "mit"), (0.2, "cc-by,cc-by-nc"), (0.4, "gpl"), (0.0, "reserved"), (0.9, "gpl,mit"), (0.6, "gpl"), (0.6, "gpl,lgpl"), (0.5, ""), (0.5, ""),
    ]
    assert scan.license_scan(cases.frame(spark, [(1, "x")]).limit(0)).collect() == []
