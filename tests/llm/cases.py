"""Small tables and plain statements of the results that operators are held against."""

import hashlib
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kind int, blob string, _spans string, _doc int, n int, score double, _t string, _w int, salt int, rank int, component_id long"


def texts(n=120, seed=3):
    """(doc_id, text): near and exact copies, shared passages, short, empty and null texts, an id that is null, repeated rows."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(150)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(5, 110))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.3:
            words = words[: r.randint(1, len(words))]
        rows.append((r.randint(0, 10**6) * 1000 + i, r.choice([" ", " ", "\n"]).join(words).capitalize()))
    rows += [(5, None), (7, ""), (8, " \n\t"), (9, "a b"), (10, "A  b"), (11, "é" * 60), (12, "aé" + "é" * 59), (13, "x" * 500), (14, "x" * 49), (None, "x" * 100), (15, "long " * 4000), (16, "long " * 4001)]
    return rows + [rows[0], rows[1]]


def wide(spark, rows):
    """The rows with further columns whose names operators use inside."""
    filler = ("en", "s", 1, "b", 1, "x", "x", 1, 1, 0.5, "t", 1, 1, 1, 1)
    return spark.createDataFrame([(d, t, *filler) for d, t in rows], CLASHING)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def removed(rows):
    """doc_id to (bytes, removed, runs, digest of the rest)."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                mark[i : i + 50] = b"\1" * 50
        rest = bytes(x for x, y in zip(b, mark, strict=True) if not y)
        out[d] = (len(b), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1])), hashlib.sha256(rest).hexdigest())
    return out


def shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(rows):
    """doc_id to (size of its set, smallest document that links lead to)."""
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(d for d in sets if d is not None)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), None if d is None else find(d)) for d, s in sets.items()}


def linked(rows):
    """As `classes`, for more rows: only documents that share a shingle are compared."""
    sets = {d: shingles(t) for d, t in rows}
    root, holders = {d: d for d in sets}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        shared = {}
        for x in s:
            for e in holders.setdefault(x, []):
                shared[e] = shared.get(e, 0) + 1
            holders[x].append(d)
        for e, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}
