"""Helpers over Arrow string columns and ragged numpy arrays, for code inside Spark tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; returns a new array."""
    x = x ^ (x >> S33)
    x *= M
    x ^= x >> S33
    x *= M2
    x ^= x >> S33
    return x


#: Spans of up to so many bytes are hashed together; longer ones one by one.
LONG = 96


class SpanHash:
    """Hashes of slices of one byte array; equal slices have equal hashes anywhere.

    Eight bytes at a time go through the finalizer with what came before, so no algebraic structure of the bytes
    survives; slices of more than LONG bytes are hashed by BLAKE2.
    """

    def __init__(self, data: np.ndarray):
        self.data = np.ascontiguousarray(data, dtype=np.uint8)
        at = np.zeros(len(data) + 8, dtype=np.uint64)
        at[: len(data)] = self.data
        for n in (1, 2, 4):
            at[:-n] |= at[n:] << np.uint64(8 * n)
        self.eight = at  # the eight bytes from each place on, little-endian

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        size = end - start
        h = mix(size.astype(np.uint64) * M2 + BASE + np.uint64(seed))
        live = np.flatnonzero((size > 0) & (size <= LONG))
        done = 0
        while len(live):
            left = size[live] - done
            block = self.eight[start[live] + done]
            short = left < 8
            block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[live] = mix(h[live] * BASE ^ block)
            done += 8
            live = live[left > 8]
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
        return h

    def same(self, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
        """Which slices have the same bytes as the slices beside them."""
        size = end - start
        out = size == end2 - start2
        live = np.flatnonzero(out & (size > 0) & (size <= LONG) & (start != start2))
        done = 0
        while len(live):
            left = np.minimum(size[live] - done, 8).astype(np.uint64)
            unlike = (self.eight[start[live] + done] ^ self.eight[start2[live] + done]) << ((np.uint64(8) - left) * np.uint64(8))
            out[live[unlike != 0]] = False
            done += 8
            live = live[(unlike == 0) & (size[live] > done)]
        for i in np.flatnonzero(out & (size > LONG) & (start != start2)).tolist():
            out[i] = np.array_equal(self.data[start[i] : end[i]], self.data[start2[i] : end2[i]])
        return out


def numbered(spans: SpanHash, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which slice stands for each distinct content, and the number of each slice's content; bytes are compared."""
    hashes = spans(start, end)
    by = np.argsort(hashes, kind="stable")
    ordered = hashes[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    where, number = by[new], np.empty(len(by), np.int64)
    number[by] = np.cumsum(new) - 1
    if not spans.same(start, end, start[where][number], end[where][number]).all():  # two contents have one hash
        raw, seen = spans.data.tobytes(), {}
        number = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.int64)
        where = np.unique(number, return_index=True)[1]
    return where, number


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = 0
        total = np.cumsum(sizes)
        while cut < len(sizes):
            before = total[cut - 1] if cut else 0
            end = max(cut + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(cut, end - cut)
            cut = end


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside x20 and x09-x0D, and how many each text has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - at, count)
