"""Byte-exact removal of passages that an earlier document has, with suffix arrays over what may repeat in part.

Every window of SPAN bytes has an anchor: the GRAM bytes in it with the least hash, so equal windows have equal
anchors. An anchor's context is the text that the windows it stands for cover.

1. Contexts meet by anchor. One that an earlier document has whole is a repeat, told by 64 bits of a chained hash
   of its bytes and at least 56 bits of its anchor's hash; this is counted within a task before anything is
   shuffled, so copies cost a row for each task that sees them.
2. Anchors with different contexts in several documents go back to their texts for the bytes. Contexts are cut
   to what they have in common with another one; equal ones count once. What is left is suffix-sorted, bucket
   by bucket: equal windows stand together there, and all but the smallest document's are repeats.

Null and short texts lose nothing, nor do rows without an id. Rows that share an id never remove each other;
they must be equal, else which of the texts is cut where is not defined. Very long texts are read whole, in segments. An empty table gives no rows. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lyndon import suffix_array
from .ragged import BASE, SpanHash, chunks, mix, numbered, spread, utf8
from .shared import release, written

SPAN, GRAM = 50, 24
REACH = SPAN - GRAM
#: Windows hashed at once; positions in such a segment fit in POSITION bits.
SEGMENT, POSITION = 1 << 20, 21
#: Text whose anchors are gathered before they are sent on, and rows of other kinds.
FLUSH, ROWS = 16 << 20, 300_000
#: Bytes of text whose anchors share a bucket; there are 256 buckets at least.
BUCKET = 8 << 20
#: Symbols suffix-sorted at once; a group of contexts stays together.
SORTED = 1 << 18
SPAN_ROW = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
EDGE_ROW = np.dtype([("doc", "<i8"), ("anchor", "<u8"), ("start", "<u4"), ("left", "u1"), ("size", "u1")])
TEXT_ROW = np.dtype([*EDGE_ROW.descr, ("text", "u1", (SPAN + REACH,))])
SPANS, EDGES, ANCHORS = 1, 2, 3
BLOBS = "bucket int, kind int, blob binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at every position, by doubling."""

    def grown(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
        return a[: len(a) - m] * np.uint64(pow(int(BASE), m, 1 << 64)) + b[n:]

    h = mix(np.arange(256, dtype=np.uint64) + np.uint64(7))[data]
    for n in (1, 2, 4):
        h = grown(h, n, h, n)
    sixteen = grown(h, 8, h, 8)
    return mix(grown(sixteen, 16, h, 8))  # 16 and 8


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, text number, and in bytes of `data` the context's start, anchor and end."""
    parts = []
    low = np.uint64((1 << POSITION) - 1)
    for base in range(0, max(len(data) - SPAN + 1, 0), SEGMENT):
        part = data[base : base + SEGMENT + SPAN - 1]
        hashes = gram_hashes(part)
        key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            key = np.minimum(key[:-step], key[step:])
        rest = REACH + 1 - 16
        key = np.minimum(key[: len(key) - rest], key[rest:])
        at = (key & low).astype(np.int64)
        start = np.arange(len(at))
        doc = np.searchsorted(offsets, start + base, side="right") - 1
        inside = start + base + SPAN <= offsets[doc + 1]
        start, at, doc = start[inside], at[inside], doc[inside]
        if not len(start):
            continue
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
        last = np.append(new[1:], len(start)) - 1
        anchor, begin, end = at[new], start[new], start[last] + SPAN
        whole = SpanHash(part)(begin, end)
        parts.append((hashes[anchor], mix(whole + (anchor - begin).astype(np.uint64)), doc[new], begin + base, anchor + base, end + base))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def doc_bucket(doc: np.ndarray, bits: int) -> np.ndarray:
    return bucket_of(mix(doc.astype(np.uint64) + np.uint64(3)), bits)


def blobs(bucket: np.ndarray, rows: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket as one blob."""
    if len(rows):
        by = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[by], rows[by]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = rows.dtype.itemsize
        offsets = pa.py_buffer((np.append(first, len(rows)) * size).astype(np.int32).tobytes())
        blob = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(rows.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(np.full(len(first), kind), pa.int32()), blob], ["bucket", "kind", "blob"])


def merged(rows: np.ndarray) -> np.ndarray:
    """Spans as maximal runs per document."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    change = np.append(False, rows["doc"][1:] != rows["doc"][:-1])
    reach = np.maximum.accumulate((np.cumsum(change) << 34) | rows["end"].astype(np.int64))
    before = np.append(-1, reach[:-1] & ((1 << 34) - 1))
    new = np.flatnonzero(change | (rows["start"] > before))
    out = rows[new].copy()
    out["end"] = reach[np.append(new[1:], len(rows)) - 1] & ((1 << 34) - 1)
    return out


def spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), SPAN_ROW)
    out["doc"], out["start"], out["end"] = doc, start, end
    return out


def least_of_equal(key: np.ndarray, doc: np.ndarray, also: np.ndarray | None = None) -> np.ndarray:
    """For each row the smallest document among the rows of its key, and of its `also` where that is given."""
    by = np.argsort(key, kind="stable")
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[by[1:]] != key[by[:-1]]
    if also is not None and (~first[1:] & (also[by[1:]] != also[by[:-1]])).any():
        by = np.lexsort((also, key))
        first[1:] = (key[by[1:]] != key[by[:-1]]) | (also[by[1:]] != also[by[:-1]])
    out = np.empty(len(doc), doc.dtype)
    if len(doc):
        out[by] = np.minimum.reduceat(doc[by], np.flatnonzero(first))[np.cumsum(first) - 1]
    return out


def pack(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray, start: np.ndarray, left: np.ndarray, size: np.ndarray) -> bytes:
    """The context hashes and 48 bits of the anchors as they are (the bucket has an anchor's high bits), the rest compressed."""
    six = np.ascontiguousarray(anchor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    rest = np.diff(doc, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() + start.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    rest += left.astype("u1").tobytes() + size.astype("u1").tobytes()
    return len(anchor).to_bytes(4, "little") + six + whole.astype("<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(rest)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(blob[:4], "little")
    anchor = np.zeros((n, 8), np.uint8)
    anchor[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, 4).reshape(n, 6)
    whole = np.frombuffer(blob[4 + 6 * n : 4 + 14 * n], "<u8")
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 + 14 * n :]), np.uint8)
    plane = lambda at, width, kind: np.ascontiguousarray(rest[at : at + width * n].reshape(width, n).T).view(kind).ravel()
    doc = np.cumsum(plane(0, 8, "<i8"))
    return anchor.view("<u8").ravel(), whole, doc, plane(8 * n, 4, "<u4").astype(np.int64), rest[12 * n : 13 * n], rest[13 * n : 14 * n]


def send_anchors(bits: int):
    """Documents to blobs of anchors by anchor, and of the spans already known to repeat, by document."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchor, whole, doc, start, left, size = (np.concatenate(x) for x in zip(*held, strict=True))
        least = least_of_equal(whole, doc, anchor)
        again = doc > least
        known = merged(spans(doc[again], start[again], (start + size)[again]))
        yield from blobs(doc_bucket(known["doc"], bits), known, SPANS)
        anchor, whole, doc, start, left, size = (x[~again] for x in (anchor, whole, doc, start, left, size))
        bucket = bucket_of(anchor, bits)
        by = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        bucket = bucket[by]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(by) else []
        packed, numbers = [], []
        for a, b in zip(cut, np.append(cut[1:], len(by)) if len(by) else [], strict=True):
            rows = by[a:b]
            packed.append(pack(*(x[rows] for x in (anchor, whole, doc, start, left, size))))
            numbers.append(bucket[a])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([ANCHORS] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in chunks(batches, "text", SEGMENT):
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            anchor, whole, doc, begin, at, end = contexts(data, offsets)
            held.append((anchor, whole, ids[doc], begin - offsets[doc], (at - begin).astype(np.uint8), (end - begin).astype(np.uint8)))
            total += len(data)
            if total >= FLUSH:
                yield from flush(held)
                held, total = [], 0
        if held:
            yield from flush(held)

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The blobs of each bucket by kind, from rows that are sorted by bucket."""
    now, held = None, {}
    for batch in batches:
        for bucket, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


def joined(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=kind)


def meet_anchors(bits: int):
    """Blobs of anchors to spans that repeat whole contexts, and to edges: contexts that differ at one anchor."""

    def one(parts: list[bytes], high: int) -> tuple[np.ndarray, np.ndarray]:
        anchor, whole, doc, start, left, size = (np.concatenate(x) for x in zip(*map(unpack, parts), strict=True))
        least = least_of_equal(whole, doc, anchor)
        again = doc > least
        found = merged(spans(doc[again], start[again], (start + size)[again]))
        rest = np.flatnonzero(~again)
        several = least_of_equal(anchor[rest], doc[rest]) != -least_of_equal(anchor[rest], -doc[rest])
        rest = rest[several]
        edges = np.empty(len(rest), EDGE_ROW)
        edges["doc"], edges["anchor"] = doc[rest], anchor[rest] & np.uint64((1 << 48) - 1) | np.uint64(high << (64 - bits) if bits else 0) & ~np.uint64((1 << 48) - 1)
        edges["start"], edges["left"], edges["size"] = start[rest], left[rest], size[rest]
        return found, edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {SPANS: [], EDGES: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    rows = np.concatenate(parts)
                    rows = merged(rows) if kind == SPANS else rows
                    yield from blobs(doc_bucket(rows["doc"], bits), rows, kind)
                    parts.clear()

        for bucket, kinds in by_bucket(batches):
            if SPANS in kinds:
                held[SPANS].append(joined(kinds[SPANS], SPAN_ROW))
            if ANCHORS in kinds:
                for kind, rows in zip((SPANS, EDGES), one(kinds[ANCHORS], bucket), strict=True):
                    held[kind].append(rows)
            if sum(len(x) for parts in held.values() for x in parts) >= ROWS:
                yield from flush()
        yield from flush()

    return run


def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and edges of document buckets to a row for each document."""
    for _, kinds in by_bucket(batches):
        found, edges = merged(joined(kinds.get(SPANS, []), SPAN_ROW)), joined(kinds.get(EDGES, []), EDGE_ROW)
        edges = edges[np.argsort(edges["doc"], kind="stable")]
        docs = np.union1d(found["doc"], edges["doc"])
        columns = [pa.array(docs, pa.int64())]
        for rows in (found, edges):
            cut = np.append(np.searchsorted(rows["doc"], docs), len(rows)) * rows.dtype.itemsize
            columns.append(pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())]))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "edges"])


def fetch_contexts(bits: int):
    """Documents with their edges to blobs of contexts by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in chunks(batches, "text", 4 << 20):
            data, offsets = utf8(batch.column("text"))
            parts = [np.frombuffer(x or b"", EDGE_ROW) for x in batch.column("edges").to_pylist()]
            edges = np.concatenate(parts) if parts else np.zeros(0, EDGE_ROW)
            rows = np.zeros(len(edges), TEXT_ROW)
            for name in EDGE_ROW.names:
                rows[name] = edges[name]
            at = np.repeat(offsets[:-1], [len(p) for p in parts]) + edges["start"]
            size = edges["size"].astype(np.int64)
            rows["text"][np.repeat(np.arange(len(rows)), size), spread(np.zeros(len(rows), np.int64), size)] = data[spread(at, size)]
            held.append(rows)
            if sum(map(len, held)) >= ROWS // 2:
                rows = np.concatenate(held)
                yield from blobs(bucket_of(rows["anchor"], bits), rows, EDGES)
                held = []
        if held:
            rows = np.concatenate(held)
            yield from blobs(bucket_of(rows["anchor"], bits), rows, EDGES)

    return run


def common(anchor: np.ndarray, sides: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many leading bytes of its row of `sides` each context shares with another one of its anchor, at most."""
    wide = np.zeros((len(sides), 32), np.uint8)
    wide[:, : sides.shape[1]] = sides
    words = wide.view(">u8").astype(np.uint64)
    # By size last: of contexts that padding makes equal, the shorter one must not stand between longer ones.
    by = np.lexsort((size, *words.T[::-1], anchor))
    a, s, n = anchor[by], sides[by], size[by]
    same = np.cumprod(s[1:] == s[:-1], axis=1).sum(1)
    same = np.where(a[1:] == a[:-1], np.minimum(same, np.minimum(n[1:], n[:-1])), -1)
    out = np.empty(len(by), np.int64)
    out[by] = np.maximum(np.append(-1, same), np.append(same, -1))
    return out


def compare_contexts(rows: np.ndarray) -> np.ndarray:
    """The spans of windows in these contexts that a smaller document has at the same anchor."""
    text, left, size = rows["text"], rows["left"].astype(np.int64), rows["size"].astype(np.int64)
    right = size - left - GRAM
    step, line = np.arange(REACH), np.arange(len(rows))[:, None]
    before = np.where(step < left[:, None], text[line, np.maximum(left[:, None] - 1 - step, 0)], 0)
    after = np.where(step < right[:, None], text[line, np.minimum(left[:, None] + GRAM + step, SPAN + REACH - 1)], 0)
    lead, tail = common(rows["anchor"], before, left), common(rows["anchor"], after, right)
    # Only windows inside what it shares on both sides can be elsewhere.
    use = np.flatnonzero((lead >= 0) & (tail >= 0) & (lead + GRAM + tail >= SPAN))
    rows, lo, n = rows[use], (left - lead)[use], (lead + GRAM + tail)[use]
    if not len(rows):
        return np.zeros(0, SPAN_ROW)
    flat = rows["text"][np.repeat(np.arange(len(rows)), n), spread(lo, n)]
    at = np.cumsum(n) - n
    # What has the same anchor, bytes and place of the anchor in them is of one kind; bytes are compared.
    key = np.unique(np.stack([rows["anchor"], lead[use].astype(np.uint64), numbered(SpanHash(flat), at, at + n)[1].astype(np.uint64)], 1), axis=0, return_inverse=True)[1].ravel()
    doc, start = rows["doc"], rows["start"].astype(np.int64) + lo
    again = doc > least_of_equal(key, doc)
    found = [spans(doc[again], start[again], (start + n)[again])]
    # One text of each kind is sorted; whatever is found in it holds for all rows of its kind that are left.
    rest = np.flatnonzero(~again)
    kinds, pick, kind = np.unique(key[rest], return_index=True, return_inverse=True)
    pick = rest[pick]
    by = np.argsort(rows["anchor"][pick], kind="stable")
    anchors = rows["anchor"][pick][by]
    first = np.append(True, anchors[1:] != anchors[:-1])
    alone = np.append(first[1:], True) & first
    order = by[~alone]
    members = rest[np.argsort(kind, kind="stable")]
    upto = np.searchsorted(np.sort(kind), np.arange(len(kinds) + 1))
    cut = 0
    while cut < len(order):
        total = np.cumsum(n[pick[order[cut:]]] + 1)
        end = cut + max(1, int(np.searchsorted(total, SORTED)))
        while end < len(order) and rows["anchor"][pick[order[end]]] == rows["anchor"][pick[order[end - 1]]]:
            end += 1
        part = order[cut:end]
        cut = end
        who = pick[part]
        width = n[who]
        symbols = np.zeros(int(width.sum()) + len(part), np.int64)  # a 0 after each text
        begin = np.cumsum(width + 1) - width - 1
        symbols[spread(begin, width)] = flat[spread(at[who], width)].astype(np.int64) + 1
        suffixes = np.array(suffix_array(symbols.tolist()), dtype=np.int64)
        owner = np.repeat(np.arange(len(part)), width + 1)[suffixes]
        whole = suffixes + SPAN <= (begin + width)[owner]
        suffixes, owner = suffixes[whole], owner[whole]
        # Equal windows are neighbours in this order; a window has no 0 in it.
        a, b = suffixes[1:], suffixes[:-1]
        head = np.append(True, ~SpanHash((symbols - 1).astype(np.uint8)).same(a, a + SPAN, b, b + SPAN))[: len(suffixes)]
        if not len(suffixes):
            continue
        d = doc[who][owner]
        least = np.minimum.reduceat(d, np.flatnonzero(head))[np.cumsum(head) - 1]
        later = np.flatnonzero(d > least)
        # Every row of the kind has the window at the same place of its text.
        texts = part[owner[later]]
        shift = suffixes[later] - begin[owner[later]]
        count = upto[texts + 1] - upto[texts]
        row, shift = members[spread(upto[texts], count)], np.repeat(shift, count)
        found.append(spans(doc[row], start[row] + shift, start[row] + shift + SPAN))
    return merged(np.concatenate(found))


def sort_contexts(bits: int):
    """Blobs of contexts to blobs of spans by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, kinds in by_bucket(batches):
            rows = joined(kinds[EDGES], TEXT_ROW)
            held.append(compare_contexts(rows))
            if sum(map(len, held)) >= ROWS:
                rows = merged(np.concatenate(held))
                yield from blobs(doc_bucket(rows["doc"], bits), rows, SPANS)
                held = []
        if held:
            rows = merged(np.concatenate(held))
            yield from blobs(doc_bucket(rows["doc"], bits), rows, SPANS)

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id and its spans to remove, as one or two blobs of SPAN_ROW. docs: doc_id long, text string."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL AND octet_length(text) >= %d" % SPAN)
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, (total // BUCKET).bit_length())
    gather = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "kind")
    met = gather(docs.mapInArrow(send_anchors(bits), BLOBS)).mapInArrow(meet_anchors(bits), BLOBS)
    known = written(gather(met).mapInArrow(per_document, "doc_id long, spans binary, edges binary"), "repeats")
    release(spark)
    open_ends = known.filter("octet_length(edges) > 0").select("doc_id", "edges")
    texts = docs.join(open_ends, "doc_id").select("text", "edges").mapInArrow(fetch_contexts(bits), BLOBS)
    partial = gather(gather(texts).mapInArrow(sort_contexts(bits), BLOBS)).mapInArrow(per_document, "doc_id long, spans binary, edges binary")
    partial = written(partial.select("doc_id", "spans"), "partial")
    release(spark)
    return known.select("doc_id", "spans").union(partial).filter("octet_length(spans) > 0")


def kept(text: bytes, blobs_: list[bytes]) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    rows = merged(joined(blobs_, SPAN_ROW))
    if not len(rows):
        return text, 0, 0
    out, at = [], 0
    for a, b in zip(rows["start"].tolist(), rows["end"].tolist(), strict=True):
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out), int((rows["end"].astype(np.int64) - rows["start"]).sum()), len(rows)


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with a column `_spans` that lists the document's blobs (null: none)."""
    return docs.join(found.groupBy("doc_id").agg(F.collect_list("spans").alias("_spans")), "doc_id", "left")


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its bytes, how many of them repeat an earlier document's passages, the runs, and a digest of the rest."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, found in zip(batch.column("text"), batch.column("_spans").to_pylist(), strict=True):
                raw = (value.as_py() or "").encode()
                rest, removed, runs = kept(raw, found or [])
                rows.append((len(raw), removed, runs, hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    picked = with_spans(docs, repeated_spans(docs)).select("doc_id", "text", "_spans")
    return picked.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeats taken out of their texts; a character that loses some of its bytes goes as a whole."""
    found = repeated_spans(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    key, blobs_ = (next(n for n in ("_" * k + name for k in range(1, 99)) if n not in docs.columns) for name in ("doc", "spans"))
    found = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("spans").alias(blobs_))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else kept(t.encode(), s)[0].decode("utf-8", errors="ignore") if s else t for t, s in zip(batch.column(text).to_pylist(), batch.column(blobs_).to_pylist(), strict=True)]
            names = [n for n in batch.schema.names if n not in (key, blobs_)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names], names)

    return docs.join(found, docs[doc_id] == found[key], "left").mapInArrow(cut, docs.schema)
