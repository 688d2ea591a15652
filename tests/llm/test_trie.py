import hashlib
import random
import zlib

import pytest

from sluiceworks.llm import prefix_trie as trie
from sluiceworks.llm import queries

from .. import oracle

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, key string, path string, depth int, kind int, size long, d string, n int, base long, head int, own int"


def brute(rows):
    """The nodes by prefix, every member at every depth."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    members = {}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(family, [])[:h] + own[c][h:]
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p in members:
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + own_saved
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, convs=80, hot=40):
    """Conversations of a few turns from a small vocabulary, so that many share beginnings; some equal, some long, some nothing but their family's head."""
    r = random.Random(seed)
    words = ["", "a", "b", "é😀", None]
    rows = []
    for _ in range(convs):
        c = r.choice([r.randint(0, 500), r.randint(-300, 10**12)])
        rows += [(c, r.choice([k, k, None]), r.choice(["user", "", None]), r.choice(words)) for k in range(r.randint(0, 9))]
    for c in range(1000, 1000 + hot):
        rows += [(c, k, "user", "same") for k in range(12)]
    rows += [(7, k, "user", "x" * (k % 3)) for k in range(300)] + [(8, k, "user", "x" * (k % 3)) for k in range(290)]
    rows += [(1200, 0, "user", "long " * 9000), (1201, 3, "user", "y"), (1201, 3, "user", "z"), (1201, 3, "user", "z"), (None, 0, "user", "x"), (None, None, None, None), (10**15 + 100, None, None, None)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", 1, 2, 3, "d", 1, 1, 1, 1) for r in rows], SCHEMA).repartition(3)


def result(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_nodes_equal_brute_force(spark, seed):
    rows = made(seed)
    assert result(trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_small_pieces_and_many_tasks(spark, monkeypatch):
    """Groups of equal conversations that several tasks hold, ids that travel in pieces of a few bytes."""
    monkeypatch.setattr(trie, "PIECE", 20)
    monkeypatch.setattr(trie, "ROWS", 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = made(5, hot=90)
        assert result(trie.prefix_trie(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("cuts", [1, 2, 3, 7, 50])
def test_any_cut_of_the_sorted_paths_gives_the_same_trie(cuts):
    """The tree of a task and the stitching alone, on random paths: complete nodes and seams add up to the plain trie."""
    import pyarrow as pa

    for seed in range(30):
        r = random.Random(seed * 97 + cuts)
        alphabet = [bytes([k]) * trie.WIDTH for k in range(r.randint(1, 3))]
        paths = sorted((b"".join(r.choice(alphabet) for _ in range(r.randint(0, 5))), k) for k in range(r.randint(1, 40)))
        rows = []
        bounds = sorted(r.randint(0, len(paths)) for _ in range(cuts - 1))
        for a, b in zip([0, *bounds], [*bounds, len(paths)], strict=True):
            part = paths[a:b]
            batch = pa.RecordBatch.from_arrays([pa.array([k for _, k in part], pa.int64()), pa.array([p for p, _ in part], pa.binary()), pa.array([[3] * (len(p) // trie.WIDTH) for p, _ in part], pa.list_(pa.int32()))], ["conv_id", "path", "sizes"])
            for out in trie.grown(iter([batch])):
                rows += out.to_pylist()
        members = {}
        for p, k in paths:
            for d in range(len(p) // trie.WIDTH + 1):
                members.setdefault(p[: d * trie.WIDTH], []).append(k)
        merged = {}
        for x in rows:
            if x["kind"] == trie.SEAM:
                y = merged.setdefault(x["key"], {**x, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0})
                y["conv_id"] = min(y["conv_id"], x["conv_id"])
                for c in trie.FIGURES:
                    y[c] += x[c]
        names = ["key", "parent_key", "conv_id", "depth", "size", *trie.FIGURES]
        batch = pa.RecordBatch.from_pylist([{n: y[n] for n in names} for y in merged.values()])
        nodes = [x for out in trie.stitched(iter([batch])) for x in out.to_pylist()] + [x for x in rows if x["kind"] == trie.NODE]
        assert len(nodes) == len(members)
        want = []
        for p, m in members.items():
            below = [q for q in members if q.startswith(p)]
            kids = [q for q in below if len(q) == len(p) + trie.WIDTH]
            leaf = [q for q in below if not any(z.startswith(q) and len(z) > len(q) for z in members)]
            want.append((min(m), len(p) // trie.WIDTH, len(m), len(kids), len(leaf), sum((len(members[q]) - 1) * 3 for q in below if q)))
        assert sorted((x["conv_id"], x["depth"], *(x[c] for c in trie.FIGURES)) for x in nodes) == sorted(want)


def test_nothing_and_turnless(spark):
    assert trie.prefix_trie(frame(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)  # its only turn goes, its family has none
    assert result(trie.prefix_trie(frame(spark, [(c, 0, "user", "x")]))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query_equals_its_sql(spark):
    got, expected = oracle.both(spark, oracle.views(SF), queries.QUERIES["op12_prefix_trie"], queries.ORACLES["op12_prefix_trie"], SF)
    assert got == expected and len(got[1]) > 0
