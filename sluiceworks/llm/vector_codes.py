"""Vector code compression: product quantization in integers, so that every run on any cluster gives the same bits.

A component x becomes floor(1024 x), a vector PARTS equal parts, and each part the number of its nearest codebook entry. The
codebooks are broadcast; Arrow batches compute all squared distances as |x|^2 - 2 x.c + |c|^2 in int64 and take the first least.
A round sums the parts of each entry inside a task, merges these sums by a grouped shuffle of at most PARTS * entries
rows a task, and replaces entries by the floor of the mean; entries that nothing chose stay.

Rows go whose vector is null or has null or non-finite components. Integers are held to +-2**28, so that distances are exact
in 64 bits. The smallest kept vec_id sets the width; vectors of another width can't be compared and go too, and a width that PARTS does
not divide is filled up with zeros. Rows with a null vec_id are coded, but start no codebook unless there are no others to. Rows that share a vec_id each count; among
them the start of the codebooks is settled by the vector's own components. Ties go to the lower index. An empty table gives no
rows, and columns besides the id, the vector and the label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LIMIT = 1 << 28
#: Vectors compared with a codebook at once.
BLOCK = 2048
CODED = "vec_id long, code binary, error long, label string"


def integers(vector: Column) -> Column:
    """floor(SCALE x) of every component, held to +-LIMIT; null where the vector is null or has a null or non-finite component."""
    x = vector.cast("array<double>")
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(usable, F.transform(x, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")))


def parts_of(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The batch's vectors as (rows, parts, width of a part)."""
    column = batch.column("v").cast(pa.list_(pa.int32()))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a part the first nearest entry of its codebook, and the squared distance."""
    half = part @ book.T
    distance = (book * book).sum(1) - 2 * half
    at = distance.argmin(1)
    return at, distance[np.arange(len(at)), at] + (part * part).sum(1)


def prepared(vectors: DataFrame, parts: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label as a string, and the vector's integers, of the rows that are kept; all of one width."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), integers(F.col(vector)).alias("v")).filter(F.size("v") > 0)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    width = first[0] if first else parts
    fill = -width % parts
    rows = rows.filter(F.size("v") == width)
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), fill))) if fill else rows


def start(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The codebooks of the smallest vec_ids as (parts, entries, width); fewer entries where there are fewer rows."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").take(entries)
    if not least:
        return np.zeros((parts, 0, 1), np.int64)
    return np.array([r[0] for r in least], dtype=np.int64).reshape(len(least), parts, -1).transpose(1, 0, 2).copy()


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books)
    parts, entries, width = books.shape
    names = [f"s{k}" for k in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        total, count = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
        for batch in batches:
            whole = parts_of(batch, parts)
            for lo in range(0, len(whole), BLOCK):
                for p in range(parts):
                    part = whole[lo : lo + BLOCK, p]
                    at = nearest(part, now[p])[0]
                    by = np.argsort(at, kind="stable")
                    used, first = np.unique(at[by], return_index=True)
                    total[p, used] += np.add.reduceat(part[by], first)
                    count[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *(pa.array(x) for x in total[p, e].T)], ["part", "entry", "n", *names])

    found = rows.select("v").mapInArrow(sums, ", ".join(f"{x} long" for x in ("part", "entry", "n", *names)))
    merged = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(x).cast("decimal(28,0)")).alias(x) for x in names))
    out = books.copy()
    for r in merged.collect():  # a row for each entry at most
        out[r["part"], r["entry"]] = [int(r[x]) // r["n"] for x in names]
    sent.destroy()
    return out


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, one byte a part, the squared distance to what the code stands for, and the label."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        for batch in batches:
            whole = parts_of(batch, len(now))
            code, error = np.zeros(whole.shape[:2], np.uint8), np.zeros(len(whole), np.int64)
            for lo in range(0, len(whole), BLOCK):
                for p in range(len(now)):
                    code[lo : lo + BLOCK, p], far = nearest(whole[lo : lo + BLOCK, p], now[p])
                    error[lo : lo + BLOCK] += far
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(error), batch.column("label")], ["vec_id", "code", "error", "label"])

    return rows.select("vec_id", "v", "label").mapInArrow(run, CODED)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of prepared rows; at most 256 entries, since a code is one byte a part."""
    books = start(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(rows, books)
    return books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """What the codes stand for: vec_id and a vector of doubles."""
    sent = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        for batch in batches:
            code = np.array([list(x) for x in batch.column("code").to_pylist()], dtype=np.int64).reshape(-1, len(now))
            vector = np.concatenate([now[p][code[:, p]] for p in range(len(now))], axis=1) / scale
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(vector), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The codes of all vectors (vec_id, code, error, label) and the codebooks that they were made with."""
    rows = written(prepared(vectors, parts, vec_id, vector, label), "integers")
    books = fit(rows, parts, entries, rounds)
    return coded(rows, books), books


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector its code in hex, its error, the error summed over its label (nulls together), and a digest of the codebooks."""
    codes, books = compressed(vectors, vec_id, vector, label)
    codes = written(codes, "codes")
    sums = codes.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_of"))).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL over the view `embeddings`, for ids that do not repeat, widths that do not differ and values of common size."""
    distance = "list_inner_product(b.c, b.c) - 2 * list_inner_product(x.v, b.c)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.vec_id, x.part, x.v, arg_min(b.entry, ({distance}) * {entries} + b.entry) AS entry FROM x JOIN b{k} b USING (part) GROUP BY ALL)")
        if k < rounds:
            means = f"SELECT part, entry, list(m ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(v[i]) / count(*))::BIGINT AS m FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, COALESCE(m.c, b.c) AS c FROM b{k} b LEFT JOIN ({means}) m USING (part, entry))")
    last = rounds
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM x QUALIFY entry < {entries}),
{", ".join(steps)},
d AS (SELECT a.vec_id, string_agg(lower(printf('%02x', a.entry)), '' ORDER BY a.part) AS code,
             sum(list_inner_product(a.v, a.v) + list_inner_product(b.c, b.c) - 2 * list_inner_product(a.v, b.c))::BIGINT AS error
      FROM a{last} a JOIN b{last} b USING (part, entry) GROUP BY a.vec_id),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})
SELECT d.vec_id, d.code, d.error, (sum(d.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, s.codebooks_sha256 FROM d JOIN k USING (vec_id), s
"""
