"""Quality classifier: nearest-neighbour voting among labelled documents in a latent semantic space.

A text becomes term counts (hashed words, word shapes, pairs of shapes, repeated windows), weighted by inverse
document frequency and projected on singular vectors of the labelled rows. The labelled vectors, at most
FIT_ROWS of DIMENSIONS numbers, are broadcast; every document's cosines with all of them are computed in
blocks, and the nearest vote with the power POWER of their similarity.

Empty and null texts have no terms: their score is the share of label 1 among the labelled rows. Without any
labelled row every score is 0.5. Ties among neighbours are broken by their order, which their ids fix. An id
that has several rows is learned once, with the least of its texts and the greatest of its labels. Each row is
scored by itself: repeated rows have equal scores, a very long text is read whole, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import SpanHash, chunks, lower_ascii, mix, utf8, words

#: Labelled rows at most, those with the smallest hash of their id.
FIT_ROWS = 4_000
DIMENSIONS, NEIGHBOURS, POWER = 48, 25, 4
WORD_TERMS, SHAPE_TERMS, PAIR_TERMS, STRUCTURE_TERMS = 512, 256, 240, 16
TERMS = WORD_TERMS + SHAPE_TERMS + PAIR_TERMS + STRUCTURE_TERMS
CHUNK = 4 << 20
THRESHOLD = 0.3


def shape_classes() -> np.ndarray:
    """Letters by case, digits as one, parts of other scripts as letters; signs stand for themselves."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of term frequencies per text."""
    n = len(offsets) - 1
    start, end, per = words(data, offsets)
    doc = np.repeat(np.arange(n), per)
    out = np.zeros((n, TERMS), dtype=np.float32)
    if not len(start):
        return out
    low = SpanHash(lower_ascii(data))(start, end)
    # A shape keeps one of each run of equal classes inside a word.
    kind = shape_classes()[data]
    keep = np.append(True, kind[1:] != kind[:-1])
    keep[start] = True
    upto = np.append(0, np.cumsum(keep))
    shape = SpanHash(kind[keep])(upto[start], upto[end])
    inner = doc[1:] == doc[:-1]

    def add(base: int, width: int, owner: np.ndarray, hashes: np.ndarray) -> None:
        term = (hashes % np.uint64(width)).astype(np.int64)
        out[:, base : base + width] += np.bincount(owner * width + term, minlength=n * width).reshape(n, width)

    add(0, WORD_TERMS, doc, low)
    add(WORD_TERMS, SHAPE_TERMS, doc, shape)
    add(WORD_TERMS + SHAPE_TERMS, PAIR_TERMS, doc[1:][inner], mix(shape[:-1] * np.uint64(3) + shape[1:])[inner])
    out /= np.maximum(per, 1)[:, None]
    # Structure: the share of three-word windows that occur again in the text, and of lines, on a few steps.
    window = mix(mix(low[:-2] * np.uint64(5) + low[1:-1]) * np.uint64(7) + low[2:]) if len(low) > 2 else low[:0]
    owner = doc[2:][doc[2:] == doc[:-2]] if len(low) > 2 else doc[:0]
    window = window[doc[2:] == doc[:-2]] if len(low) > 2 else window
    key = mix(window + mix(owner.astype(np.uint64) + np.uint64(1)))
    by = np.argsort(key)
    ordered = key[by]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:]
    again = np.bincount(owner[by[same]], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
    steps = np.minimum((again * 8).astype(np.int64), 7)
    base = TERMS - STRUCTURE_TERMS
    out[np.arange(n), base + steps] += (again > 0.05) * 0.5
    size = np.minimum(np.log2(np.maximum(per, 1)).astype(np.int64) // 2, 7)
    out[np.arange(n), base + 8 + size] += 0.02 * (per > 0)
    return out


@dataclass
class Model:
    weight: np.ndarray  # of each term
    basis: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # of the labelled rows, unit length
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts * 100) * self.weight @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, block: int = 2048) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(counts), block):
            part = counts[lo : lo + block]
            cosine = self.embed(part) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            # Where the last neighbour ties with others, the first ones by id count.
            tied = np.flatnonzero((cosine >= np.take_along_axis(cosine, near, 1).min(1, keepdims=True)).sum(1) > k)
            near[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(1)
            vote = np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)
            out[lo : lo + block] = np.where(part.any(1), vote, self.prior)
        return np.clip(out, 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from labelled rows outside the held-out fifth: their vectors and the weights of the terms."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    # One row per id, so that at most `rows` are broadcast, and as many texts come to the driver as terms.
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    picked = picked.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            x = term_counts(*utf8(batch.column("text"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    got = sorted(picked.mapInArrow(count, "doc_id long, y int, x binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], dtype=np.float64)
    counts = np.frombuffer(b"".join(bytes(r["x"]) for r in got), dtype=np.float32).reshape(-1, TERMS)
    if not len(y):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    weight = np.log((1 + len(y)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
    x = np.log1p(counts * 100) * weight
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    model = Model(weight, np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)), np.zeros((0, DIMENSIONS), np.float32), y, float(y.mean()))
    model.vectors = model.embed(counts)
    return model


def quality_classifier(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: held_out, score (higher: label 1 is likelier) and predicted, 1 if the score is THRESHOLD or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, "text", CHUNK):
            score = m.score(term_counts(*utf8(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
