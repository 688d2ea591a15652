"""Near-duplicate classes by the Jaccard similarity of word shingles, with a count-vector R-tree over candidates.

A document's set is its distinct shingles of WIDTH words (all words as one shingle if there are fewer). Equal
sets form a class with the smallest document as representative; only representatives go on. Two sets that are
similar enough share a shingle among the first few of either in any fixed order. Here rare shingles come first:
those that a share of the corpus holds come last, so a common passage brings nobody together who has much else.
Shingles hash into groups; the counts make each set a point, and summed minima of coordinates bound the overlap of
two points or of two boxes of points from above. What the bound allows is verified on the shingles themselves.

1. Stars. Representatives that show one shingle meet; each is held against one of the meeting, the one with most
   common shingles. Pairs that the bound allows are verified, and components follow. This is linear in the rows
   that meet, and joins most of a group of near copies.
2. The rest. Meetings that still have several components are gathered by the least one and cut into blocks of
   BLOCK points, which are the leaves of an R-tree over the gathering. Pairs of blocks whose boxes allow a link
   between components are searched inside, by smaller leaves; first on points, to find who has an allowed partner,
   then on the shingles of those. Only links that join components are sent on.

So every link between components is found, no task holds more than two blocks, and a group of near copies is never
written out as pairs. A shingle that very many documents show is spread over tasks by range.

Null and blank texts have no shingles and stand alone. Rows without an id get no component. Repeated rows of
one id count as one document. Very long texts are read whole. An empty table gives no rows; other columns are ignored.
Shingles are told by 64-bit hashes, and sets are taken as equal if their sizes and two 64-bit sums over their shingles are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .members import Members, perhaps
from .ragged import SpanHash, chunks, lower_ascii, mix, utf8, words
from .shared import release, written

WIDTH = 5
#: Similarity in hundredths.
LEAST = 80
#: Groups of the points in the tree at least; larger sets have more, of about FINE shingles each, and where the shingles
#: themselves are at hand, of about FINEST.
GROUPS, FINE, FINEST = 64, 8, 2
LEAF = 16
#: Points, and shingles of these, in a block; a larger set is a block by itself.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: A shingle is common if so many documents hold it; the MOST_COMMON most frequent of these are told to all tasks
#: (12 MB). Both only set the order of shingles, on which no result depends.
COMMON, MOST_COMMON = 6, 1 << 20
CHUNK, FLUSH = 2 << 20, 2 << 20
SETS = "doc_id long, n long, s1 long, s2 long, heat int, counts binary, first array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, end to end, and n + 1 offsets."""
    start, end, per = words(data, offsets)
    hashes = SpanHash(lower_ascii(data))(start, end) if len(start) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for j in range(width):
        rolled = mix(rolled + hashes[j : j + len(rolled)]) * np.uint64(0x9E3779B97F4A7C15)
    rolled = mix(rolled)
    out, at = [np.zeros(0, np.uint64)], 0
    for n in per.tolist():
        if n >= width:
            x = np.sort(rolled[at : at + n - width + 1])
        elif n:
            x = np.zeros(1, np.uint64) + np.uint64(n)
            for h in hashes[at : at + n]:
                x = mix(x + h) * np.uint64(0xD6E8FEB86659FD93)
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
        at += n
    flat, upto = np.concatenate(out), np.cumsum([len(x) for x in out])
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[upto[upto < len(flat)]] = True
    return flat[new], np.append(0, np.cumsum(new))[upto]


def first_few(n: int) -> int:
    """How many of its first shingles a set of n must show: one more than it may lack in a similar set."""
    return n - -(-n * LEAST // 100) + 1


def group_counts(x: np.ndarray, fine: int = FINE) -> bytes:
    """Counts by hash; the number of groups is a power of two, so that neighbours in size can be folded to the same."""
    groups = max(GROUPS, 1 << (len(x) // fine).bit_length())
    counts = np.bincount((x & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    width = 1 if counts.max() < 256 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unfolded(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts if len(counts) == groups else counts.reshape(-1, groups).sum(0)


def count_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several documents of a run of texts hold, with how many hold them."""

    def flush() -> Iterator[pa.RecordBatch]:
        x, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)), pa.array(n[keep])], ["token", "df"])

    held, total = [], 0
    for batch in chunks(batches, "text", CHUNK):
        held.append(shingle_sets(*utf8(batch.column("text")))[0])
        total += len(held[-1])
        if total >= FLUSH:
            yield from flush()
            held, total = [], 0
    if held:
        yield from flush()


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, in order, and how many documents hold each at least."""
    counted = docs.select("text").mapInArrow(count_common, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    table = counted.filter(F.col("df") >= COMMON).orderBy(F.desc("df"), "token").limit(MOST_COMMON).toArrow()
    token, df = table.column("token").to_numpy().view(np.uint64), table.column("df").to_numpy()
    by = np.argsort(token)
    return token[by], np.minimum(df[by], 1 << 31).astype(np.uint32)


def describe(common) -> Callable:
    """Each document's set: its size, two digests, how much of it is common, its point, and its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, df = common.value
        for batch in chunks(batches, "text", CHUNK):
            flat, upto = shingle_sets(*utf8(batch.column("text")))
            often = np.zeros(len(flat), np.uint32)
            if len(token):
                at = np.minimum(np.searchsorted(token, flat), len(token) - 1)
                often = np.where(token[at] == flat, df[at], 0)
            rows, first = [], []
            mixed = mix(flat)
            for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                x, k = flat[a:b], first_few(b - a) if b > a else 0
                hot = int(np.count_nonzero(often[a:b]))
                # Rare ones first, each kind in the order of hashes.
                first.append(x[np.argsort(often[a:b], kind="stable")[:k]] if hot else x[:k])
                rows.append((b - a, x.sum(dtype=np.uint64), mixed[a:b].sum(dtype=np.uint64), 1000 * hot // max(b - a, 1), group_counts(x)))
            n, s1, s2, heat, counts = zip(*rows, strict=True) if rows else [()] * 5
            cut = np.append(0, np.cumsum([len(x) for x in first])).astype(np.int32)
            shown = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)))
            whole = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *whole, pa.array(heat, pa.int32()), pa.array(counts, pa.binary()), shown], ["doc_id", "n", "s1", "s2", "heat", "counts", "first"])

    return run


def meet(token: np.ndarray, n: np.ndarray, doc: np.ndarray, heat: np.ndarray, edge: bool) -> pa.RecordBatch:
    """The meetings of rows sorted by token and size. At the edge of a task others may show the token too."""
    # A gap in the sizes ends a meeting: nobody beyond it can be similar to anybody before.
    new = np.append(True, (token[1:] != token[:-1]) | (100 * n[:-1] < LEAST * n[1:]) & (not edge))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(token)))
    if edge:
        number = mix(token.view(np.uint64)[first] + np.uint64(17))
    else:
        keep = np.repeat(size > 1, size)
        token, doc, heat, size = token[keep], doc[keep], heat[keep], size[size > 1]
        first = np.cumsum(size) - size
        # The same documents by other shingles are the same meeting.
        number = mix(np.add.reduceat(mix(doc.view(np.uint64) + np.uint64(11)), first) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)
    group = np.repeat(np.arange(len(size)), size)
    center = doc[np.lexsort((doc, -heat, group))[first]] if len(size) else doc
    return pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)[group]), pa.array(doc), pa.array(center[group])], ["meeting", "doc_id", "center"])


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range of shingles, sorted by shingle and size, to who meets whom, and the star's center."""
    names = ("token", "n", "doc_id", "heat")
    held: list[list[np.ndarray]] = []
    edge = True

    def out(parts: list[list[np.ndarray]], edge: bool) -> pa.RecordBatch:
        return meet(*(np.concatenate(x) for x in zip(*parts, strict=True)), edge)

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in names]
        token = columns[0]
        if not len(token):
            continue
        if held and token[0] != held[-1][0][-1]:
            yield out(held, edge)
            held, edge = [], False
        cut = int(np.searchsorted(token, token[-1], side="left"))
        if cut and edge:  # the first token of the task ends in this batch
            head = int(np.searchsorted(token, token[0], side="right"))
            yield out([*held, [c[:head] for c in columns]], True)
            held, edge = [], False
            if head < cut:
                yield out([[c[head:cut] for c in columns]], False)
        elif cut:
            yield out([*held, [c[:cut] for c in columns]], False)
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield out(held, True)


def allowed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the summed minima of two sets' counts leave room for the similarity. Shapes broadcast."""
    overlap = np.minimum(a, b).sum(-1)
    # 100 * i >= LEAST * (na + nb - i)
    return (100 + LEAST) * overlap >= LEAST * (na + nb)


class RTree:
    """Points packed into leaves by splitting the widest coordinate in the middle, with the leaves' boxes."""

    def __init__(self, fine: list[np.ndarray], n: np.ndarray):
        self.fine, self.n = fine, n
        self.counts = counts = np.array([folded(x, GROUPS) for x in fine])
        todo, leaves = [np.arange(len(n))], []
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            part = counts[at]
            spread_ = part.max(0) - part.min(0)
            sizes = n[at]
            by = np.argsort(sizes if sizes.max() - sizes.min() > 2 * spread_.max() else part[:, int(spread_.argmax())], kind="stable")
            half = len(at) // 2
            todo += [at[by[:half]], at[by[half:]]]
        self.leaves = leaves
        self.most = np.array([counts[x].max(0) for x in leaves])
        self.least_n = np.array([n[x].min() for x in leaves])
        self.most_n = np.array([n[x].max() for x in leaves])

    def pairs(self, apart: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each leaf with points of its own and later leaves, and which of these pairs boxes, points and `apart` allow."""
        for i, leaf in enumerate(self.leaves):
            near = (100 * self.most_n[i:] >= LEAST * self.least_n[i]) & (100 * self.most_n[i] >= LEAST * self.least_n[i:])
            others = i + np.flatnonzero(near)
            others = others[allowed(self.most[i], self.most[others], self.least_n[i], self.least_n[others])]
            for lo in range(0, len(others), 16):
                right = np.concatenate([self.leaves[j] for j in others[lo : lo + 16]])
                ok = apart(leaf, right)
                right, ok = right[ok.any(0)], ok[:, ok.any(0)]
                if not len(right):
                    continue
                ok &= allowed(self.counts[leaf][:, None], self.counts[right][None], self.n[leaf][:, None], self.n[right][None])
                right, ok = right[ok.any(0)], ok[:, ok.any(0)]
                if not len(right):
                    continue
                groups = min(len(self.fine[k]) for k in (*leaf, *right))
                if groups > GROUPS:
                    finer = [np.array([folded(self.fine[k], groups) for k in side]) for side in (leaf, right)]
                    for k in range(len(leaf)):  # a point at a time bounds the memory
                        ok[k] &= allowed(finer[0][k], finer[1], self.n[leaf[k]], self.n[right])
                if ok.any():
                    yield leaf, right, ok


def components_apart(component: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda leaf, right: component[leaf][:, None] != component[right]


def with_partner(n: np.ndarray, fine: list[np.ndarray], component: np.ndarray) -> np.ndarray:
    """Which points have a partner in another component that the bound allows."""
    named = np.zeros(len(n), dtype=bool)
    for leaf, right, ok in RTree(fine, n).pairs(components_apart(component)):
        named[leaf[ok.any(1)]] = True
        named[right[ok.any(0)]] = True
    return named


def joins(doc: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join components: every pair across components that the bound allows is held against the similarity."""
    n = np.array([len(x) for x in sets])
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    def apart(leaf: np.ndarray, right: np.ndarray) -> np.ndarray:
        x, y = (np.array([find(c) for c in component[side].tolist()]) for side in (leaf, right))
        return x[:, None] != y

    out = []
    for leaf, right, ok in RTree([unfolded(group_counts(x, FINEST)) for x in sets], n).pairs(apart):
        some = np.unique(np.concatenate([sets[k] for k in leaf]))
        has = np.zeros((len(leaf), len(some) + 1), dtype=np.int32)
        for k, x in enumerate(leaf):
            has[k, np.searchsorted(some, sets[x])] = 1
        for lo in range(0, len(right), LEAF):
            part = right[lo : lo + LEAF]
            flat = np.concatenate([sets[k] for k in part])
            at = np.searchsorted(some, flat)
            at[some[np.minimum(at, len(some) - 1)] != flat] = len(some)
            shared = np.add.reduceat(has[:, at], np.cumsum(n[part]) - n[part], axis=1)
            linked = ok[:, lo : lo + LEAF] & (100 * shared >= LEAST * (n[leaf][:, None] + n[part] - shared))
            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = int(leaf[i]), int(part[j])
                p, q = find(int(component[x])), find(int(component[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(doc[x]), int(doc[y])))
    return out


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= LEAST * (len(x) + len(y) - shared)


def points_allow(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> bool:
    groups = min(len(x[1]), len(y[1]))
    return bool(allowed(folded(x[1], groups), folded(y[1], groups), x[0], y[0]))


def star(pairs: DataFrame, of: DataFrame, decode: Callable, test: Callable, block: int = BLOCK) -> DataFrame:
    """The (center, doc_id) whose payloads pass the test. of: doc_id, n, payload. pairs must be a written table.

    A center with very many partners is dealt over several groups; its payload goes to each of them once."""
    counted = pairs.groupBy("center").agg(F.count("*").alias("often"))
    most = max(block, pairs.count() // 1000)
    large = counted.filter(F.col("often") > most).select("center", F.ceil(F.col("often") / most).cast("int").alias("parts"))  # at most 1000 rows
    salted = pairs.join(F.broadcast(large), "center", "left").select("center", F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts"), F.lit(0)).cast("int").alias("salt"), "doc_id")
    hubs = salted.select("center", "salt").distinct()
    both = salted.join(of, "doc_id").select("center", "salt", F.lit(1).alias("kind"), "doc_id", "n", "payload")
    both = both.union(hubs.join(of.withColumnRenamed("doc_id", "center"), "center").select("center", "salt", F.lit(0).alias("kind"), F.col("center").alias("doc_id"), "n", "payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of_center = None, None
        for batch in batches:
            found = ([], [])
            for center, kind, doc, n, payload in zip(*(batch.column(c).to_pylist() for c in ("center", "kind", "doc_id", "n", "payload")), strict=True):
                if not kind:
                    hub, of_center = decode(n, payload), center
                elif of_center == center and test(hub, decode(n, payload)):
                    found[0].append(center)
                    found[1].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["center", "doc_id"])

    return both.repartition("center", "salt").sortWithinPartitions("center", "salt", "kind").mapInArrow(run, "center long, doc_id long")


def whole_sets(docs: DataFrame, members: Members) -> DataFrame:
    """The sets of the documents that may be members; what is not, a join has to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(members.has(batch.column("place"))))
            for part in chunks([batch], "text", CHUNK):
                flat, upto = shingle_sets(*utf8(part.column("text")))
                cut = pa.py_buffer((upto * 8).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(upto)), pa.Array.from_buffers(pa.binary(), len(part), [None, cut, pa.py_buffer(flat.tobytes())])], ["doc_id", "n", "payload"])

    return docs.withColumn("place", members.place("doc_id")).mapInArrow(run, "doc_id long, n long, payload binary")


def cut_blocks(most: int) -> Callable:
    """Rows sorted by gathering, component and size to the same rows with their block; its first row has its box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch ends a block too
            gathering, component, doc, n = (batch.column(c).to_numpy() for c in ("gathering", "component_id", "doc_id", "n"))
            blocks = np.empty(len(doc), np.int64)
            first: list[int] = []
            now, size, shingles = None, 0, 0
            for k, (g, d, m) in enumerate(zip(gathering.tolist(), doc.tolist(), n.tolist(), strict=True)):
                if now is None or now[0] != g or size >= most or shingles + m > BLOCK_SHINGLES:
                    now, size, shingles = (g, d), 0, 0
                    first.append(k)
                blocks[k], size, shingles = now[1], size + 1, shingles + m
            counts = [unfolded(x) for x in batch.column("payload").to_pylist()]
            boxes, bounds = [None] * len(doc), [[None] * len(doc) for _ in range(4)]
            for a, b in zip(first, [*first[1:], len(doc)], strict=False):
                boxes[a] = np.max([folded(c, GROUPS) for c in counts[a:b]], axis=0).astype("<i4").tobytes()
                for into, value in zip(bounds, (n[a:b].min(), n[a:b].max(), component[a:b].min(), component[a:b].max()), strict=True):
                    into[a] = int(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks), pa.array(boxes, pa.binary()), *(pa.array(x, pa.int64()) for x in bounds)], [*batch.schema.names, "block", "box", "least_n", "most_n", "least_c", "most_c"])

    return run


def boxes_allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks whose boxes leave room for a link."""
    for batch in batches:
        x, y = (np.array([np.frombuffer(b, "<i4") for b in batch.column(c).to_pylist()]).reshape(-1, GROUPS) for c in ("box", "box2"))
        ok = allowed(x, y, *(batch.column(c).to_numpy() for c in ("least_n", "least_n2")))
        yield batch.select(["gathering", "block", "block2"]).filter(pa.array(ok))


def by_pair(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple[int, int, int], list[list]]]:
    """The values of these columns for each pair of blocks, from rows that are sorted by pair."""
    key, now, held = ("gathering", "block", "block2"), None, [[] for _ in names]
    for batch in batches:
        number = [batch.column(c).to_numpy() for c in key]
        columns = [batch.column(c).to_pylist() for c in names]
        new = np.zeros(max(len(batch) - 1, 0), dtype=bool)
        for x in number:
            new |= x[1:] != x[:-1]
        cut = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if lo == hi:
                continue
            this = tuple(int(x[lo]) for x in number)
            if this != now:
                if held[0]:
                    yield now, held
                now, held = this, [[] for _ in names]
            for h, c in zip(held, columns, strict=True):
                h += c[lo:hi]
    if held[0]:
        yield now, held


def name_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks with points to the rows that have an allowed partner in another component."""
    for key, (doc, component, n, payload) in by_pair(batches, ["doc_id", "component_id", "n", "payload"]):
        at = np.flatnonzero(with_partner(np.array(n), [unfolded(b) for b in payload], np.array(component)))
        if len(at):
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(at), pa.int64()) for k in key), pa.array(np.array(doc)[at]), pa.array(np.array(component)[at])], ["gathering", "block", "block2", "doc_id", "component_id"])


def join_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks with whole sets to the links that join their components."""
    for _, (doc, component, payload) in by_pair(batches, ["doc_id", "component_id", "payload"]):
        links = joins(np.array(doc), np.array(component), [np.frombuffer(b, "<u8") for b in payload])
        if links:
            a, b = (list(x) for x in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def gathered(rows: DataFrame) -> DataFrame:
    """Rows of pairs of blocks together and in order."""
    key = ("gathering", "block", "block2")
    return rows.repartition(*key).sortWithinPartitions(*key)


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document its id, n_shingles, and component_id, the smallest document that links lead to."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(docs))
    sets = written(docs.mapInArrow(describe(common), SETS), "sets")
    key = ["n", "s1", "s2"]
    classes = written(sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    # Most documents stand for themselves; only those with copies go through a join to find out who stands for them.
    copied = classes.filter("rows > 1")
    copies = Members(sets.select("doc_id", *key).join(copied.select(*key), key).select("doc_id"))
    some = sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "heat", "first")
    reps = perhaps(some, copies).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).union(perhaps(some, copies, inside=False))
    shown = reps.select(F.explode("first").alias("token"), "n", "doc_id", "heat")
    # By range, so that a shingle that very many show is dealt over tasks.
    met = shown.repartitionByRange("token", "n", "doc_id").sortWithinPartitions("token", "n", "doc_id").mapInArrow(meetings, "meeting long, doc_id long, center long")
    met = written(met.distinct(), "met")
    release(spark)
    points = written(perhaps(sets.select("doc_id", "n", F.col("counts").alias("payload")), Members(met.select("doc_id"))), "points")
    pairs = written(met.filter("center <> doc_id").select("center", "doc_id").distinct(), "pairs")
    pairs = written(star(pairs, points, lambda n, x: (n, unfolded(x)), points_allow, block), "allowed")
    full = written(whole_sets(docs, Members(pairs.select("doc_id").union(pairs.select("center")))), "shingles")
    labels = components(star(pairs, full, lambda n, x: np.frombuffer(x, "<u8"), similar, block).select(F.col("center").alias("a"), F.col("doc_id").alias("b")))
    release(spark)
    placed = met.select("meeting", "doc_id").join(labels, "doc_id", "left").select("meeting", "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    span = placed.groupBy("meeting").agg(F.min("component_id").alias("gathering"), F.max("component_id").alias("hi")).filter("gathering < hi").drop("hi")
    open_ = placed.join(span, "meeting").select("gathering", "component_id", "doc_id").distinct().join(points, "doc_id").select("gathering", "component_id", "doc_id", "n", "payload")
    order = ("gathering", "component_id", "n", "doc_id")
    kinds = "gathering long, component_id long, doc_id long, n long, payload binary, block long, box binary, least_n long, most_n long, least_c long, most_c long"
    blocks = written(open_.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut_blocks(block), kinds), "blocks")
    release(spark)
    boxes = blocks.filter("box IS NOT NULL").select("gathering", "block", "box", "least_n", "most_n", "least_c", "most_c")
    others = boxes.select("gathering", *(F.col(c).alias(f"{c}2") for c in boxes.columns[1:]))
    close = f"block <= block2 AND 100 * most_n2 >= {LEAST} * least_n AND 100 * most_n >= {LEAST} * least_n2 AND NOT (least_c = most_c AND least_c2 = most_c2 AND least_c = least_c2)"
    near = written(boxes.join(others, "gathering").filter(close).mapInArrow(boxes_allow, "gathering long, block long, block2 long"), "near")
    rows = blocks.select("gathering", "block", "component_id", "doc_id", "n", "payload")
    sides = near.join(rows, ["gathering", "block"]).unionByName(near.filter("block <> block2").join(rows.withColumnRenamed("block", "block2"), ["gathering", "block2"]))
    named = written(gathered(sides).mapInArrow(name_points, "gathering long, block long, block2 long, doc_id long, component_id long"), "named")
    release(spark)
    more = written(gathered(named.join(whole_sets(docs, Members(named.select("doc_id"))), "doc_id")).mapInArrow(join_sets, "a long, b long").distinct(), "links")
    if more.take(1):
        labels = components(labels.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).union(more))
    release(spark)
    roots = classes.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select(*key, F.coalesce("component_id", "rep").alias("component_id"))
    out = sets.select("doc_id", *key).join(roots, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
