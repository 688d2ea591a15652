import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from sluiceworks.llm import queries, vector_codes

from .. import oracle

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, part int, entry int, code string, error int, n int, s0 int"


def brute(rows, width):
    """(vec_id, code, error, label_error) and the digest of the codebooks, entry by entry."""
    kept = [(i, [max(-(1 << 28), min(1 << 28, math.floor(1024 * np.float32(x).item()))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if len(r[1]) == width]
    fill = -width % 4
    kept = [(i, v + [0] * fill, label) for i, v, label in kept]
    w = (width + fill) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]]
    books = [[cut(v, p) for v in first] for p in range(4)]

    def choose(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(4):
        new = [list(b) for b in books]
        for p in range(4):
            held = {}
            for _, v, _ in kept:
                held.setdefault(choose(v, p)[1], []).append(cut(v, p))
            for k, some in held.items():
                new[p][k] = [sum(x) // len(some) for x in zip(*some, strict=True)]
        books = new
    out, by = [], {}
    for i, v, label in kept:
        best = [choose(v, p) for p in range(4)]
        error = sum(d for d, _ in best)
        out.append((i, "".join("%02x" % k for _, k in best), error, label))
        by[label] = by.get(label, 0) + error
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(((i, c, e, by[label]) for i, c, e, label in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, "c", 1, 1, 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("width", [8, 6])
def test_codes_equal_brute_force(spark, width):
    r = random.Random(width)
    rows = [(r.randint(0, 10**9), [r.choice([r.gauss(0, 1), r.choice([-0.5, 0.25, 1.0])]) for _ in range(width)], r.choice([None, 1, 2])) for _ in range(330)]
    rows += [(1, None, 1), (2, [0.1, None] + [0.0] * (width - 2), 1), (3, [math.nan] * width, 2), (4, [math.inf] + [0.0] * (width - 1), None), (5, [], 1), (10**10, [1.0] * (width + 1), 1)]
    rows += [rows[0], rows[0], (None, [0.5] * width, None), (10**11, [3e38, -3e38] + [0.0] * (width - 2), 9), (10**11 + 1, [-1 / 4096] * width, 9)]
    got = vector_codes.vector_codes(frame(spark, rows)).collect()
    want, digest = brute(rows, width)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_fewer_rows_than_entries_and_none(spark):
    rows = [(k, [float(k)] * 4, 1) for k in range(3)]
    got = vector_codes.vector_codes(frame(spark, rows)).orderBy("vec_id").collect()
    assert [(r.code, r.error) for r in got] == [("00000000", 0), ("01010101", 0), ("02020202", 0)]
    assert vector_codes.vector_codes(frame(spark, rows).limit(0)).collect() == []
    assert vector_codes.vector_codes(frame(spark, [(1, None, 1)])).collect() == []


def test_codes_stand_for_near_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    codes, books = vector_codes.compressed(rows)
    error = {r.vec_id: r.error for r in codes.collect()}
    back = {r.vec_id: r.vector for r in vector_codes.decoded(codes, books).collect()}
    for r in rows.collect():
        exact = sum((math.floor(1024 * x) - 1024 * y) ** 2 for x, y in zip(r.embedding, back[r.vec_id], strict=True))
        assert abs(exact - error[r.vec_id]) < 1e-6 * max(1, exact)


def test_query_equals_its_sql(spark):
    got, expected = oracle.both(spark, oracle.views(SF), queries.QUERIES["op13_vector_codes"], queries.ORACLES["op13_vector_codes"], SF)
    assert got == expected and len(got[1]) > 0
    assert duckdb.__version__
