"""Byte-level BPE encoding and decoding with a pair occurrence index over whole Arrow batches.

Encoding cuts a batch into pieces with array operations, keeps each distinct piece once (their bytes are compared), and merges all
new pieces of the batch together: an index maps each mergeable pair to every position that holds it, the
active ranks are applied in ascending order, and each application updates the lists of the pairs it touches.
Null texts count as empty and give no ids; equal texts give equal ids. A very long text is encoded whole, as a batch by itself. Null ids are kept,
an empty table gives no rows, and columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import SpanHash, chunks, numbered, spread

#: Distinct pieces a worker remembers; beyond that it starts anew. It bounds memory and changes no result.
MOST_PIECES = 1_000_000
#: UTF-8 bytes encoded at once.
CHUNK = 2 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The contractions that the pre-tokenizer pattern names, in its order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    kinds = np.array(kinds, dtype="U1")
    out[kinds == "L"] = LETTER
    out[kinds == "N"] = NUMBER
    out[WHITE] = SPACE
    return out


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def piece_starts(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's pieces start, over texts end to end; ends: where each text ends."""
    n = len(cps)
    kind = classes()[cps]
    first = np.zeros(n + 1, dtype=bool)
    first[0] = True
    first[ends] = True
    first = first[:n]
    begin = first.copy()
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = cps[:-1] == 0x20
    space = kind == SPACE
    change = kind != before
    # White space starts a piece as a run does; words take one blank before them along.
    begin |= change & ~(after_blank & ~space)
    # The last character of a run that a word follows stands apart from the rest of the run.
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = ~space[1:] & ~first[1:]
    begin |= space & follows
    mark = np.flatnonzero(cps == 0x27)
    if len(mark):
        free = first[mark] | ((before[mark] != OTHER) & ~after_blank[mark])
        mark = mark[free]
        stop = np.searchsorted(ends, mark, side="right")
        room = ends[np.minimum(stop, len(ends) - 1)] - mark - 1
        done = np.zeros(len(mark), dtype=bool)
        for tail in CONTRACTIONS:
            k = len(tail)
            hit = ~done & (room >= k)
            for j, c in enumerate(tail):
                hit[hit] = cps[mark[hit] + 1 + j] == ord(c)
            at = mark[hit]
            begin[at] = True
            begin[at + 1] = False
            past = at[room[hit] > k] + 1 + k
            begin[past[kind[past] == LETTER]] = True
            done |= hit
    return np.flatnonzero(begin)


def sorted_once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x if len(x) < 2 else x[np.append(True, x[1:] != x[:-1])]


class Bpe:
    """One vocabulary in a worker, with what it has encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, to_byte = spec["model"]["vocab"], byte_symbols()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, new = (np.array(x, dtype=np.int64) for x in ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs]))
        key = (left << 20) | right
        self.order = np.argsort(key)
        self.keys, self.new, self.none = key[self.order], new, len(pairs)
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in to_byte.items():
            self.byte_id[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for token, i in vocab.items():
            strings[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            strings[i] = token.encode()
        self.token_start = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(s) for s in strings], out=self.token_start[1:])
        self.token_bytes = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of pieces, sorted
        self.check = np.zeros(0, np.uint64)  # a second hash of each, with another seed
        self.place = np.zeros(0, np.int64)  # of their ids in flat
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], self.none)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and how many each has."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n, ends = len(sym), np.cumsum(sizes)
        after = np.arange(1, n + 1)
        after[ends - 1] = n
        before = np.arange(-1, n - 1)
        before[ends - sizes] = n
        before, after = np.append(before, n), np.append(after, n)  # n stands for none
        rank = np.full(n + 1, self.none)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.rank(sym[inner], sym[after[inner]])
        sym = np.append(sym, 0)
        alive = np.ones(n + 1, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put positions on the lists of the pairs that they hold now."""
            r = rank[at]
            at, r = at[r < self.none], r[r < self.none]
            if not len(at):
                return
            if len(r) > 1:
                by = np.argsort(r)
                at, r = at[by], r[by]
            cut = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for k, a, b in zip(r[cut[:-1]].tolist(), cut, cut[1:], strict=False):
                part = at[a:b]
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(active, k)

        enter(inner)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            at = sorted_once(at[alive[at] & (rank[at] == r)])
            if not len(at):
                continue
            if len(at) > 1 and (chain := after[at[:-1]] == at[1:]).any():
                # Overlapping occurrences, as in "aaa": every second one of a chain, from its left, counts.
                head = np.append(True, ~chain)
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            gone = after[at]
            sym[at] = self.new[r]
            alive[gone] = False
            far = after[gone]
            after[at] = far
            before[far] = at
            before[n] = after[n] = n
            near = before[at]
            touched = sorted_once(np.concatenate([at, near[near < n]]))
            has = after[touched] < n
            rank[touched[~has]] = self.none
            touched = touched[has]
            rank[touched] = self.rank(sym[touched], sym[after[touched]])
            enter(touched)
        left = np.flatnonzero(alive[:n])
        return sym[left], np.diff(np.searchsorted(left, np.append(0, ends)))

    def learn(self, hashes: np.ndarray, checks: np.ndarray, pieces: list[bytes]) -> None:
        ids, count = self.merge(pieces)
        place = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, ids])
        known = np.concatenate([self.known, hashes])
        by = np.argsort(known, kind="stable")
        self.known, self.check, self.place, self.count = known[by], *(np.concatenate(x)[by] for x in ((self.check, checks), (self.place, place), (self.count, count)))

    def find(self, hashes: np.ndarray, checks: np.ndarray, pieces: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and count of the ids of distinct pieces, and the ids these point into. `pieces` gives the bytes of some of them.

        Known pieces are told by 128 bits. Should two pieces share the first 64, this run is merged without memory."""

        def look() -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
            return at, self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)

        at, seen = look()
        if (self.check[at[seen]] != checks[seen]).any() or len(np.unique(hashes)) < len(hashes):
            ids, count = self.merge(pieces(np.arange(len(hashes))))
            return np.cumsum(count) - count, count, ids
        new = np.flatnonzero(~seen)
        if len(new):
            if len(self.known) + len(new) > MOST_PIECES:
                self.forget()
                new = np.arange(len(hashes))
            self.learn(hashes[new], checks[new], pieces(new))
            at, _ = look()
        return self.place[at], self.count[at], self.flat

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and n + 1 offsets."""
        if any(s in t for s in self.special for t in texts):
            return self.encode_special(texts)
        return self.encode_plain(texts)

    def encode_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        (token, token_id), parts, owner = next(iter(self.special.items())), [], []
        for i, t in enumerate(texts):
            for part in t.split(token):
                parts.append(part)
                owner.append(i)
        ids, at = self.encode_plain(parts)
        owner = np.array(owner)
        glue = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # a special token stands before these parts
        size = np.diff(at)
        total = np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64) + np.bincount(owner[glue], minlength=len(texts))
        return np.insert(ids, at[glue], token_id), np.append(0, np.cumsum(total))

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        if not text:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        start = piece_starts(cps, ends)
        raw = text.encode()
        at_byte = np.append(0, np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000), dtype=np.int64))
        begin, end = at_byte[start], np.append(at_byte[start[1:]], len(raw))
        spans = SpanHash(np.frombuffer(raw, dtype=np.uint8))
        where, number = numbered(spans, begin, end)
        a, b = begin[where], end[where]
        place, count, flat = self.find(spans(a, b), spans(a, b, 1), lambda some: [raw[x:y] for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)])
        count = count[number]
        ids = flat[spread(place[number], count)]
        upto = np.append(0, np.cumsum(count))
        return ids, upto[np.append(0, np.searchsorted(start, ends))]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        start = self.token_start[ids]
        return self.token_bytes[spread(start, self.token_start[ids + 1] - start)].tobytes()


class RoundBpe(Bpe):
    """The same ids, for callers that only need them: each round merges the lowest-ranked pair of every piece."""

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        out, where = [], []
        while len(sym):
            last = np.append(owner[1:] != owner[:-1], True)
            rank = np.full(len(sym), self.none)
            inner = np.flatnonzero(~last)
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
            head = np.flatnonzero(np.append(True, last[:-1]))
            least = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            least = np.repeat(least, size)
            done = least == self.none
            out.append(sym[done])
            where.append(owner[done])
            hit = (rank == least) & ~done
            at = np.flatnonzero(hit)
            if len(at) > 1 and (chain := np.append(False, at[1:] == at[:-1] + 1)).any():
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(~chain, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            sym[at] = self.new[rank[at]]
            keep = ~done
            keep[at + 1] = False
            sym, owner = sym[keep], owner[keep]
        where = np.concatenate(where) if where else np.zeros(0, np.int64)
        by = np.argsort(where, kind="stable")
        return np.concatenate(out)[by] if out else np.zeros(0, np.int64), np.bincount(where, minlength=len(pieces))


@cache
def loaded(path: str, kind: type[Bpe] = Bpe) -> Bpe:
    return kind(path)


def encoded(batches: Iterator[pa.RecordBatch], column: str, path: str, kind: type[Bpe] = Bpe) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each run of rows with its ids and offsets."""
    bpe = loaded(path, kind)
    for batch in chunks(batches, column, CHUNK):
        texts = pc.fill_null(batch.column(column), "").to_pylist()
        ids, at = bpe.encode(texts)
        yield batch, ids, at


def bpe_round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text: its number of ids, digests of the ids and of the decoded text.

    One row per input row (null text: as empty); other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch, ids, at in encoded(batches, "text", path):
            raw, cut = ids.astype("<u4"), at.tolist()
            decoded = bpe.decode_bytes(ids)
            width = np.append(0, np.cumsum(bpe.token_start[ids + 1] - bpe.token_start[ids]))[at].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)], pa.string()),
                    pa.array([hashlib.sha256(decoded[a:b].decode("utf-8", errors="replace").encode()).hexdigest() for a, b in zip(width, width[1:], strict=False)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids themselves, one array per row (null text: an empty array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, at in encoded(batches, "text", path):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_texts(ids: DataFrame, path: str, doc_id: str = "doc_id", column: str = "ids") -> DataFrame:
    """Decode arrays of ids back to text (null: an empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            rows = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.string())], ["doc_id", "text"])

    return ids.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).alias("ids")).mapInArrow(run, "doc_id long, text string")
