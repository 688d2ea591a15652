"""The prefix trie of conversations, built as a Patricia tree: points only at branches, ends and leaves, with edges between.

A turn is told by 128 bits of the SHA-256 of its role and text, so a conversation is a path of 16 bytes a turn. Paths are sorted
by range over all tasks. A task reads its paths in order and holds one of them as a stack of points; a point that the next
path leaves is complete: its members, least conv_id, leaves and savings are known, and the nodes of the edge above it
follow from it by suffix sums of their turns' sizes. Nodes on a task's first and last path may go on in the tasks beside it. These seams
are merged by a shuffle, and the small trie that they form, two paths a task, is summed up in one task.

The ids of those that end at a node are hashed while they pass; where they are many, or lie at a seam, they travel as pieces of
PIECE bytes and are hashed one piece after the other, so no list of ids is ever whole in memory.

Null roles and texts count as empty; turns sort with null first, those of one turn by their digests. Repeated rows are repeated turns. Rows
without a conv_id belong to no conversation and go. c%100 takes the sign of c. An empty table gives no rows. Texts may be of any length and
leave the table as digests and sizes; a conversation's path, 20 bytes a turn, must fit in a task. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

WIDTH, HEADS, FAMILY = 16, 6, 100
#: Bytes of ids that travel together, and rows sent on at once.
PIECE, ROWS = 1 << 16, 1 << 14
NODE, SEAM, ENDS = 0, 1, 2
GROWN = "kind int, key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, size long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
COLUMNS = [x.split()[0] for x in GROWN.split(", ")]
KINDS = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in GROWN.split(", ")]
FIGURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
EMPTY = hashlib.sha256(b"").digest()


def digest_of(role: Column, text: Column) -> Column:
    """The first 2 * WIDTH hex digits of the SHA-256 of a turn."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def paths(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, path and sizes (code points of each turn's text) of every rebuilt conversation."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    turns = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest_of(role_, text_).alias("d"), F.length(text_).alias("n")).alias("t")).filter("conv_id IS NOT NULL")
    own = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["d"], x["n"])).alias("own"))
    heads = own.filter(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    rebuilt = F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<struct<d:string,n:int>>")), F.slice("own", h + 1, F.size("own")))
    return both.select("conv_id", rebuilt.alias("r")).select("conv_id", F.unhex(F.array_join(F.transform("r", lambda x: x["d"]), "")).alias("path"), F.transform("r", lambda x: x["n"]).alias("sizes"))


def shared(a: bytes, b: bytes) -> int:
    """The turns at the beginning that two paths have in common."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while high - low > 1:
        half = (low + high) // 2
        if a[low * WIDTH : half * WIDTH] == b[low * WIDTH : half * WIDTH]:
            low = half
        else:
            high = half
    return low


def keys_of(path: bytes) -> list[bytes]:
    """A key for the node at every depth of a path, the root's first."""
    running = hashlib.sha256()
    out = [running.digest()[:WIDTH]]
    for at in range(0, len(path), WIDTH):
        running.update(path[at : at + WIDTH])
        out.append(running.digest()[:WIDTH])
    return out


class Point:
    """A node of the compressed tree on the path that is read just now. `waiting` holds children that lack only its least conv_id."""

    __slots__ = ("depth", "n", "least", "children", "leaves", "saved", "ids", "first", "sent", "waiting")

    def __init__(self, depth: int):
        self.depth, self.n, self.least, self.children, self.leaves, self.saved = depth, 0, None, 0, 0, 0
        self.ids, self.first, self.sent, self.waiting = bytearray(), None, False, []

    def gain(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


class Grower:
    """One task's Patricia tree over sorted paths; `rows` are those of GROWN that are done."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.stack = [Point(0)]
        self.path, self.sizes = b"", []
        self.first: bytes | None = None
        self.first_keys: list[bytes] = []
        self.on_first = 0  # depth up to which the path that was read last goes along with the first one

    def key(self, depth: int) -> bytes:
        return self.first_keys[depth] if depth <= self.on_first else hashlib.sha256(self.path[: depth * WIDTH]).digest()[:WIDTH]

    def add(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        if self.first is None:
            self.first, self.first_keys, self.on_first = path, keys_of(path), len(path) // WIDTH
        else:
            common = shared(self.path, path)
            self.leave(common)
            self.on_first = min(self.on_first, common)
        self.path, self.sizes = path, sizes
        if len(path) // WIDTH > self.stack[-1].depth:
            self.stack.append(Point(len(path) // WIDTH))
        end = self.stack[-1]
        end.gain(1, conv_id)
        if end.first is None:
            end.first = conv_id
        end.ids += b",%d" % conv_id
        if len(end.ids) > PIECE:
            self.send_ids(end)

    def send_ids(self, point: Point) -> None:
        """What has gathered of the ids that end here, as one piece."""
        if point.ids:
            self.rows.append((ENDS, self.key(point.depth), None, point.first, None, None, None, None, None, None, None, bytes(point.ids[1:])))
            point.ids, point.first, point.sent = bytearray(), None, True

    def leave(self, depth: int) -> None:
        """Close the points below `depth`, which the next path does not share."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth))
            if point.depth <= self.on_first:
                self.seam(point, self.stack[-1], self.first_keys)
            else:
                self.close(point, self.stack[-1])

    def close(self, point: Point, above: Point) -> None:
        """The nodes of a complete point and of the edge over it."""
        if point.sent:
            self.send_ids(point)
        ends_key = self.key(point.depth) if point.sent else None
        self.rows += [(*row[:4], point.least, *row[5:]) for row in point.waiting]
        leaves, children, saved = point.leaves or 1, point.children, point.saved
        ends = None if point.sent else hashlib.sha256(point.ids[1:]).digest() if point.ids else EMPTY
        for depth in range(point.depth, above.depth, -1):
            saved += (point.n - 1) * self.sizes[depth - 1]
            row = (NODE, ends_key, None, point.least, point.least, depth, None, point.n, children, leaves, saved, ends)
            ends_key, children, ends = None, 1, EMPTY
            if depth > above.depth + 1:
                self.rows.append(row)
            elif above.depth <= self.on_first:
                self.rows.append((NODE, row[1], self.first_keys[above.depth], row[3], None, *row[5:]))
            else:
                above.waiting.append(row)
        above.gain(point.n, point.least)
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved

    def seam(self, point: Point, above: Point | None, keys: list[bytes]) -> None:
        """The nodes of a point and of the edge over it with what this task knows of them."""
        self.send_ids(point)
        self.rows += [(NODE, row[1], keys[point.depth], row[3], None, *row[5:]) for row in point.waiting]
        figures = (point.children, point.leaves, point.saved)
        for depth in range(point.depth, above.depth if above else -1, -1):
            self.rows.append((SEAM, keys[depth], keys[depth - 1] if depth else None, point.least, None, depth, self.sizes[depth - 1] if depth else 0, point.n, *figures, None))
            figures = (0, 0, 0)
        if above:
            above.gain(point.n, point.least)

    def finish(self) -> None:
        """The last path is a seam as a whole."""
        if self.first is not None:
            keys = keys_of(self.path)
            while self.stack:
                self.seam(self.stack.pop(), self.stack[-1] if self.stack else None, keys)


def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths to rows of GROWN: complete nodes, parts of nodes at seams, and pieces of ids."""

    def sent() -> pa.RecordBatch:
        columns = list(zip(*tree.rows, strict=True)) or [()] * len(COLUMNS)
        tree.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS, strict=True)], COLUMNS)

    tree = Grower()
    for batch in batches:
        for conv_id, path, sizes in zip(*(batch.column(c) for c in ("conv_id", "path", "sizes")), strict=True):
            tree.add(conv_id.as_py(), path.as_py(), sizes.as_py())
            if len(tree.rows) > ROWS:
                yield sent()
    tree.finish()
    yield sent()


def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merged seams, all of them, with the sums over the trie that they form."""
    rows: dict[bytes, dict] = {}
    for batch in batches:
        rows |= {r["key"]: r for r in batch.to_pylist()}
    for row in sorted(rows.values(), key=lambda r: -r["depth"]):
        above = rows.get(row["parent_key"])
        row["n_leaves"] = row["n_leaves"] or 1
        row["saved_tokens"] += (row["n_convs"] - 1) * row["size"]
        row["parent_conv_id"] = above and above["conv_id"]
        if above:
            above["n_children"] += 1
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
    names = ["key", "conv_id", "parent_conv_id", "depth", *FIGURES]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows.values()], KINDS[COLUMNS.index(n)]) for n in names], names)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ids, sorted by key and first id, to one digest a key."""
    keys, digests, now, running = [], [], None, None
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key == now:
                running.update(b",")
            else:
                if running:
                    keys.append(now)
                    digests.append(running.digest())
                now, running = key, hashlib.sha256()
            running.update(ids)
    if running:
        keys.append(now)
        digests.append(running.digest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.binary())], ["key", "sha"])


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node: its least member, depth, its parent's least member, and figures of its subtree."""
    sequences = written(paths(conversations, conv_id, turn, role, text), "paths")
    rows = written(sequences.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(grown, GROWN), "trie")
    parts = rows.filter(F.col("kind") == SEAM)
    seams = parts.groupBy("key", "parent_key", "depth", "size").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in FIGURES))
    seams = written(seams.repartition(1).mapInArrow(stitched, f"key binary, conv_id long, parent_conv_id long, depth long, {', '.join(f'{c} long' for c in FIGURES)}"), "seams")
    pieces = rows.filter(F.col("kind") == ENDS).select("key", "conv_id", "ends")
    digests = pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(hashed, "key binary, sha binary")

    kept = ["key", "conv_id", "parent_conv_id", "depth", *FIGURES, "ends"]
    nodes = rows.filter(F.col("kind") == NODE)
    under = seams.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    hung = nodes.filter("parent_key IS NOT NULL").join(under, "parent_key").withColumn("parent_conv_id", F.col("_above")).select(kept)
    every = nodes.filter("parent_key IS NULL").select(kept).unionByName(hung).unionByName(seams.withColumn("ends", F.lit(None).cast("binary")).select(kept))
    keyed = every.filter("key IS NOT NULL").join(digests, "key", "left").withColumn("ends", F.coalesce("sha", F.lit(EMPTY))).select(kept)
    every = every.filter("key IS NULL").unionByName(keyed)
    return every.select("conv_id", "depth", "parent_conv_id", *FIGURES, F.lower(F.hex("ends")).alias("ends_sha256"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL over the view `conversations`."""
    step = 2 * WIDTH
    return f"""
WITH tab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
t AS (SELECT conv_id, turn, left(sha256(strlen(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')), {step}) AS d, length(COALESCE(text, ''))::BIGINT AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS d, list(n ORDER BY turn NULLS FIRST, d) AS n FROM t GROUP BY conv_id),
h AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(o.conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % {HEADS} AS h FROM o, tab),
r AS MATERIALIZED (SELECT h.conv_id, list_concat(COALESCE(b.d[1:h], []), h.d[h + 1:]) AS d, list_concat(COALESCE(b.n[1:h], []), h.n[h + 1:]) AS n FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
p AS (SELECT conv_id, depth, array_to_string(d[1:depth], '') AS key, CASE WHEN depth > 0 THEN n[depth] ELSE 0 END AS size, depth = len(d) AS ends FROM (SELECT *, unnest(range(0, len(d) + 1)) AS depth FROM r)),
v AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
                          sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY key, depth),
c AS (SELECT left(key, length(key) - {step}) AS key, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
w AS MATERIALIZED (SELECT v.*, COALESCE(c.n_children, 0) AS n_children FROM v LEFT JOIN c USING (key)),
s AS (SELECT left(key, up * {step}) AS key, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN s USING (key) LEFT JOIN w q ON w.depth > 0 AND q.key = left(w.key, length(w.key) - {step})
"""
