import random

import numpy as np
import pytest

from sluiceworks.llm.jaccard_join import LEAST, allowed, first_few, jaccard_classes, joins, with_partner
from sluiceworks.llm.lyndon import suffix_array
from sluiceworks.llm.suffix_dedup import common, suffix_dedup, without_repeats

from . import cases


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array_is_the_sorted_order(letters):
    r = random.Random(letters)
    for _ in range(300):
        x = [r.randrange(letters) for _ in range(r.randint(0, 40))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i, x=x: x[i:])


def test_suffix_dedup_equals_brute_force(spark):
    rows = cases.texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(cases.wide(spark, rows).repartition(3)).collect()}
    assert got == cases.removed(rows)


def test_suffix_dedup_of_passages_cut_anywhere(spark):
    r = random.Random(9)
    base = ["".join(r.choice("ab é") for _ in range(r.randint(20, 250))) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            a = r.randrange(len(b))
            parts.append(b[a : a + r.randint(20, 150)] if r.random() < 0.7 else "".join(r.choice("abcdefgh ") for _ in range(60)))
        rows.append((r.randint(0, 999) * 1000 + i, "".join(parts)))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup(cases.frame(spark, rows)).collect()}
    assert got == cases.removed(rows)


def test_common_bytes_of_contexts_with_nul_bytes():
    r = random.Random(5)
    for made in [[b"ab\0", b"ab", b"ab\0"], *([bytes(r.choice(b"\0\0a") for _ in range(r.randint(0, 5))) for _ in range(r.randint(2, 9))] for _ in range(300))]:
        sides = np.array([list(x.ljust(6, b"\0")) for x in made], np.uint8)
        share = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        expected = [max(share(x, y) for j, y in enumerate(made) if j != i) for i, x in enumerate(made)]
        assert common(np.zeros(len(made), np.int64), sides, np.array([len(x) for x in made])).tolist() == expected


def test_without_repeats_keeps_columns_and_rows(spark):
    passage = "a passage of over fifty bytes that several documents have in common, word by word"
    rows = [(1, f"one {passage} end"), (2, f"two {passage} stop"), (3, None), (4, "short")]
    df = cases.wide(spark, rows)
    out = without_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: rows[0][1], 2: "two stop", 3: None, 4: "short"} or got[2].startswith("two") and passage not in got[2]


def test_jaccard_classes_equal_brute_force(spark):
    rows = cases.texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(cases.wide(spark, rows).repartition(3)).collect()}
    assert got == cases.classes(rows)


def test_jaccard_links_at_exactly_the_threshold(spark):
    """Sets of 9 and 9 shingles with 8 in common: 8 of 10."""
    a = [f"t{i}" for i in range(13)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:12], "other"])), (3, " ".join(["first", *a[1:12], "other"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(cases.frame(spark, rows)).collect()}
    assert got == cases.classes(rows)
    assert got[2] == (9, 1)


def test_jaccard_links_of_points_whose_partners_a_leader_took(spark):
    """Eight texts of a chain in which each differs from the one before by a word or two."""
    r = random.Random(164)
    vocabulary = [f"w{i}" for i in range(400)]
    words, chain = [r.choice(vocabulary) for _ in range(70)], []
    for _ in range(8):
        chain.append(" ".join(words))
        at = r.randrange(8, 70)
        words[at] = r.choice(vocabulary)
        if r.random() < 0.5:
            word = r.choice(vocabulary)
            words[r.randrange(8, 70)] = word
    r.shuffle(chain)
    rows = list(enumerate(chain, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(cases.frame(spark, rows)).collect()}
    assert got == cases.classes(rows)


def chains(r, n, vocabulary, words=70):
    """For each chain near copies of a text, and a path of near copies that leads away from it."""
    rows = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            copy[r.randrange(words)] = r.choice(vocabulary)
            rows.append(copy)
        rows.append(base)
        for _ in range(r.randint(0, 5)):
            base = list(base)
            for _ in range(r.randint(1, 2)):
                base[r.randrange(words)] = r.choice(vocabulary)
            rows.append(base)
    r.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows, 1)]


def test_jaccard_classes_of_many_chains_equal_brute_force(spark):
    rows = chains(random.Random(8), 400, [f"w{i}" for i in range(5000)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(cases.frame(spark, rows)).collect()}
    assert got == cases.linked(rows)


def test_jaccard_classes_in_small_blocks_and_with_a_common_passage(spark):
    """Blocks of five points, so that gatherings are searched block by block; most texts share a long passage."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)]
    passage = " ".join(r.choice(vocabulary) for _ in range(45))
    rows = [(d, f"{passage} {t}" if r.random() < 0.7 else t) for d, t in chains(r, 60, vocabulary, 40)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_classes(cases.frame(spark, rows), block=5).collect()}
    assert got == cases.linked(rows)


@pytest.mark.parametrize("size", [2, 8, 40, 90])
def test_points_with_an_allowed_partner_in_another_component(size):
    r = np.random.default_rng(size)
    for _ in range(40):
        counts = np.zeros((size, 64), np.int64)
        for row in counts:
            k = r.integers(0, 40)
            row[:2] = 100 - k, k
        n, component = counts.sum(1), r.integers(0, 3, size)
        ok = allowed(counts[:, None], counts[None], n[:, None], n[None]) & (component[:, None] != component)
        assert with_partner(n, list(counts), component).tolist() == ok.any(1).tolist()


def test_joins_connect_what_is_similar():
    r = np.random.default_rng(3)
    for _ in range(30):
        base = r.integers(0, 1 << 40, 60).astype(np.uint64)
        sets = []
        for _ in range(50):
            x = base.copy()
            x[r.integers(0, 60, r.integers(0, 12))] = r.integers(0, 1 << 40)
            sets.append(np.unique(x))
        component = r.integers(0, 9, 50)
        root = {c: c for c in range(9)}
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if 100 * len(np.intersect1d(x, y)) >= LEAST * len(np.union1d(x, y)):
                    a, b = root[int(component[i])], root[int(component[j])]
                    root = {c: min(a, b) if v in (a, b) else v for c, v in root.items()}
        found = {c: c for c in range(9)}
        for i, j in joins(np.arange(50), component, sets):
            a, b = found[int(component[i])], found[int(component[j])]
            found = {c: min(a, b) if v in (a, b) else v for c, v in found.items()}
        assert {c: found[c] for c in component.tolist()} == {c: root[c] for c in component.tolist()}


def test_first_few_cover_what_a_similar_set_may_lack():
    for n in range(1, 500):
        assert first_few(n) == n - min(k for k in range(n + 1) if 100 * k >= 80 * n) + 1


@pytest.mark.parametrize("operator", [suffix_dedup, jaccard_classes])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).collect() == []
