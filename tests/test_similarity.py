"""The q-gram join and the leaders against every pair."""

import random

import pytest

from sluiceworks.functions import edits
from sluiceworks.operators import similarity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def ratio(a, b):
    return 1.0 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def texts(n, seed, alphabet="abcé "):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 6, 7, 13, 14, 20, 33, 60]))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            at = r.randint(0, len(t))
            t[at : at + r.randint(0, 1)] = r.choice(["", r.choice(alphabet)])
        out.append("".join(t))
    return [*out, None, "", "", out[0]]


def test_gram_sizes():
    assert similarity.gram_size(0.85) == 3 and similarity.gram_size(0.3) == 1
    for t in (0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95):
        q = similarity.gram_size(t)
        assert all(n - q + 1 - q * similarity.edits(n, t) > 0 for n in range(1, 5000) if similarity.edits(n, t))


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85])
def test_pairs_equal_brute_force(spark, threshold):
    rows = list(enumerate(texts(70, int(threshold * 100))))
    got = {(r.a, r.b, round(r.similarity, 9)) for r in similarity.similar_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t", threshold).collect()}
    want = {(i, j, round(ratio(a, b), 9)) for i, a in rows for j, b in rows if i < j and a is not None and b is not None and ratio(a, b) >= threshold}
    assert got == want


def leaders(rows, threshold):
    """One row after the other, against all leaders so far."""
    found, out = [], {}
    for o, t in sorted(rows):
        if t:
            first = next((x for x, y in found if ratio(t, y) >= threshold), o)
            if first == o:
                found.append((o, t))
            out[o] = first
    return out


@pytest.mark.parametrize(("threshold", "block", "seed"), [(0.85, 8, 1), (0.7, 16, 2), (0.6, 1024, 3)])
def test_leaders_equal_a_pass_in_order(spark, threshold, block, seed):
    values = texts(90, seed)
    random.Random(seed).shuffle(values)
    rows = [(7 * k + 3, t) for k, t in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    got = {r.k: r.leader for r in similarity.leader_clusters(df, "k", "t", threshold, block).collect()}
    want = leaders(rows, threshold)
    assert got == want and len(set(want.values())) < len(want)
    counts = {}
    for x in want.values():
        counts[x] = counts.get(x, 0) + 1
    top = sorted(((n, x) for x, n in counts.items() if n > 1), key=lambda p: (-p[0], p[1]))[:10]
    shown = similarity.suspicious_clusters(similarity.leader_clusters(df, "k", "t", threshold, block), "k").collect()
    assert [(r.n, r.leader, r.alert) for r in shown] == [(n, x, n > 5) for n, x in top]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k long, t string")
    assert similarity.leader_clusters(empty, "k", "t").collect() == [] and similarity.similar_pairs(empty, "k", "t").collect() == []


def test_no_join_of_the_clusters_is_broadcast(spark):
    rows = spark.createDataFrame(list(enumerate(texts(60, 5))), "id long, text string").filter("text IS NOT NULL")
    short = similarity.prefixes(rows, 0.7)
    found = similarity._verified(similarity.meetings(short, short, 0.7), rows, rows, 0.7)
    found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_distances_of_many_texts_to_one():
    r = random.Random(7)
    for size in (1, 5, 63, 64, 65, 128, 129, 200):
        one = "".join(r.choice("abé\U0001f600") for _ in range(size))
        many = ["", one, one[::-1], one[1:], one + "xy", one[: size // 2], "z" * size, *("".join(r.choice("abé") for _ in range(n)) for n in (3, 64, 70))]
        letters, sizes, order = edits.columns(many)
        found = dict(zip(order.tolist(), edits.distances(letters, sizes, one).tolist(), strict=True))
        assert [found[i] for i in range(len(many))] == [distance(t, one) for t in many]
    assert edits.first_near([], ["a"], 0.85).tolist() == [] and edits.first_leaders(["ab", "cd", "ab"], 0.85, 2, 9) == ([0, 1], 1)
    assert edits.first_leaders(["ab", "cd", "ab"], 0.85, 1, 9) == ([0], 1) and edits.first_leaders(["ab", "cde", "ab"], 0.85, 9, 2) == ([0], 1) and edits.first_leaders(["ab"], 0.85, 1, 1) == ([], 0)


def test_rows_with_few_leaders_need_no_index(spark, monkeypatch):
    """Numbers grow from block to block, so that later blocks bring leaders of their own."""
    monkeypatch.setattr(similarity, "prefixes", lambda *_: pytest.fail("an index of q-grams"))
    monkeypatch.setattr(similarity, "WIDE", 32)
    r = random.Random(9)
    values = [f"the user {r.randrange(10 ** (1 + k // 60), 10 ** (2 + k // 60))} did {r.choice(['view', 'purchase', 'click'])} it" for k in range(300)]
    rows = [*((3 * k + 1, t) for k, t in enumerate(values)), (2, None), (5, ""), (8, values[0])]
    got = {r.k: r.leader for r in similarity.leader_clusters(spark.createDataFrame(rows, "k long, t string").repartition(3), "k", "t", 0.85, 16).collect()}
    assert got == leaders(rows, 0.85) and len(set(got.values())) > 3


@pytest.mark.parametrize("few", [0, 3, 64])
def test_leaders_by_few_and_by_index_are_the_same(spark, few):
    """Long texts, and rows of more leaders than they are compared with, are left to the index; keys may be texts."""
    r = random.Random(few)
    long = ["".join(r.choice("abcdefg ") for _ in range(n)) for n in (430, 500, 520)]
    values = [*texts(40, 11), *(t[:9] + "!" * r.randint(0, 70) + t[9:] for t in long for _ in range(3))]
    rows = [(f"{k:04}", t) for k, t in enumerate(values)]
    got = {r.k: r.leader for r in similarity.leader_clusters(spark.createDataFrame(rows, "k string, t string"), "k", "t", 0.85, 8, few).collect()}
    assert got == leaders(rows, 0.85)
