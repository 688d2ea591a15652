"""Packing token pieces into sequences: a configuration linear program over the length histogram.

Only the histogram (at most `capacity` counts) reaches the driver. Multiplicative weights with an unbounded
knapsack as pricing choose configurations and how often to use each; rounding is repeated on what it leaves,
and its last remainder is filled in by a bounded knapsack, still on the histogram. The plan is a short table of runs, and each piece finds its place in it by
its rank among the pieces of its length, which is counted in salted groups.

Null texts count as empty: one piece with the end token only. Repeated rows are packed as often as they occur.
A very long text is encoded whole and cut into pieces. An empty table gives no rows; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import RoundBpe, encoded
from .shared import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that one group ranks.
GROUP = 50_000
#: Of the solver: rounds of weights a phase, phases at most, the part of a scarcest row that a round covers, how fast weights shrink,
#: how near the best value a configuration must come, how much long pieces are favoured, and the part of a row that may stay open.
ROUNDS, PHASES, STEP, RATE, NEAR, BIAS, OPEN = 16, 12, 0.3, 3.0, 0.01, 0.3, 0.02


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document's ids and end id; of a longer one all but the first have the full capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, at in encoded(batches, "text", path, RoundBpe):
            size = np.diff(at) + 1
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = np.append(0, np.cumsum(size))
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = (size - 1) % capacity + 1
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            raw, lo = memoryview(ids).cast("B"), at[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


class Knapsack:
    """The most value within every capacity up to the given one; any length may repeat."""

    def __init__(self, lengths: np.ndarray, value: np.ndarray, capacity: int):
        self.lengths, self.value, self.capacity = lengths, value, capacity
        self.best, self.pick, self.end = np.zeros(capacity + 1), np.full(capacity + 1, -1), np.zeros(capacity + 1, np.int64)
        for c in range(int(lengths[0]), capacity + 1):
            k = int(np.searchsorted(lengths, c, side="right"))
            gain = value[:k] + self.best[c - lengths[:k]]
            j = int(gain.argmax())
            if gain[j] > self.best[c - 1]:
                self.best[c], self.pick[c], self.end[c] = gain[j], j, c
            else:  # as good with less room: the last length ends there
                self.best[c], self.end[c] = self.best[c - 1], self.end[c - 1]

    def chosen(self, capacity: int) -> Counter:
        """The multiset of lengths with the most value within this capacity."""
        out, c = Counter(), int(self.end[capacity])
        while c:
            length = int(self.lengths[self.pick[c]])
            out[length] += 1
            c = int(self.end[c - length])
        return out

    def priced(self) -> Iterator[tuple[float, Counter]]:
        """For each length the best configuration that holds it and its value, the most valuable first."""
        total = self.value + self.best[self.capacity - self.lengths]
        for j in np.argsort(-total, kind="stable").tolist():
            length = int(self.lengths[j])
            config = self.chosen(self.capacity - length)
            config[length] += 1
            yield float(total[j]), config


def least_sequences(demand: dict[int, int], capacity: int) -> float:
    """A lower bound that needs no program: the dual feasible functions floor((k + 1) x) / k of a length's share x, and x itself."""
    return max(float(sum(n * x for x, n in demand.items())) / capacity, *(sum(n * (((k + 1) * x - 1) // capacity) for x, n in demand.items()) / k for k in (1, 2, 3, 4)))


def fractional(demand: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[dict[frozenset, float], float]:
    """How often to use which configurations to cover most of the demand, and a lower bound on any solution.

    Multiplicative weights: a row is a length; its weight starts at its share of a sequence, with BIAS in favour of long pieces, and shrinks
    exponentially with the part of its demand that is covered. A round prices configurations by one knapsack over
    the rows that are open, and uses those whose value is within NEAR of the best one's, each for STEP of what is
    open in its scarcest row. It ends when no row has more than OPEN of its demand left, and that much is added to all uses. The weights of a round, divided by
    the best configuration's value, are feasible in the dual program, so they bound it from below.
    """
    uses: dict[frozenset, float] = {}
    lengths = np.array(sorted(demand), dtype=np.int64)
    need = np.array([demand[k] for k in lengths.tolist()], dtype=np.float64)
    share = lengths / capacity
    open_, bound = need.copy(), least_sequences(demand, capacity)
    place = np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    for _ in range(rounds):
        rows = np.flatnonzero(open_ > OPEN * need)
        if not len(rows):
            break
        covered = 1 - open_[rows] / need[rows]
        weight = share[rows] * (1 + BIAS * share[rows]) * np.exp(-RATE * (covered - covered.min()))
        knapsack = Knapsack(lengths[rows], weight, capacity)
        best = knapsack.best[capacity]
        bound = max(bound, float((need[rows] * weight).sum() / best))
        for value, config in knapsack.priced():
            if value < best * (1 - NEAR):
                break
            at, copies = place[list(config)], np.array(list(config.values()), dtype=np.float64)
            times = STEP * float((open_[at] / copies).min())
            if times > 1e-9:
                key = frozenset(config.items())
                uses[key] = uses.get(key, 0.0) + times
                open_[at] = np.maximum(open_[at] - times * copies, 0)
    return {key: times / (1 - OPEN) for key, times in uses.items()}, bound


def filled(left: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """What rounding leaves, one configuration after the other: the longest piece with the pieces that fill its room best.

    The knapsack here has a piece's length as its value and uses no length more often than it is left; sums that
    can be reached are bits of an integer."""
    out = []
    left = dict(left)
    while left:
        longest = max(left)
        room, config = capacity - longest, Counter({longest: 1})
        sums, before = 1, []
        for length in sorted((k for k in left if k <= room), reverse=True):
            before.append((length, sums))
            for _ in range(min(left[length] - (length == longest), room // length)):
                sums |= sums << length
            sums &= (2 << room) - 1
            if sums >> room:
                break
        at = sums.bit_length() - 1
        for length, smaller in reversed(before):
            while not smaller >> at & 1:
                config[length] += 1
                at -= length
        n = min(left[k] // a for k, a in config.items())
        out.append((n, config))
        for k, a in config.items():
            left[k] -= n * a
            if not left[k]:
                del left[k]
    return out


def plan(histogram: dict[int, int], capacity: int = 2048, phases: int = PHASES) -> tuple[list[tuple[int, Counter]], dict[str, float]]:
    """Bins as (how many, lengths in each) that hold exactly the histogram, and figures of the solution.

    Each phase solves the program for what is left and rounds it: the most used configurations come first, each
    as often as the solution says, rounded up, while what is left allows it. After every phase the rest is also filled in by the
    bounded knapsack; the shortest of these packings is taken, of equals the one with the most phases. Phases end when nothing is left,
    when the rest fits in one sequence, when a phase rounds nothing, or when the packing is as short as the bound. `bound` is
    the best lower bound of the whole program (no packing has fewer sequences); `rounded` and `filled` count the sequences of the two steps.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    bins: list[tuple[int, Counter]] = []
    lower, best, rest = 0.0, None, filled(left, capacity) if sum(k * n for k, n in left.items()) <= capacity else None
    for phase in range(phases if left and rest is None else 0):
        solution, bound = fractional(left, capacity)
        lower = lower if phase else bound
        before = len(bins)
        for key, times in sorted(solution.items(), key=lambda x: (-x[1], sorted(x[0]))):
            config = Counter(dict(key))
            n = min([-int(-times // 1), *(left.get(k, 0) // a for k, a in config.items())])
            if n > 0:
                bins.append((n, config))
                for k, a in config.items():
                    left[k] -= n * a
        left = {k: n for k, n in left.items() if n}
        if len(bins) == before:
            break
        rest = filled(left, capacity)
        total = sum(n for n, _ in bins) + sum(n for n, _ in rest)
        if best is None or total <= best[0]:
            best = total, len(bins), rest
        if sum(k * n for k, n in left.items()) <= capacity:
            break
    if best is not None:
        bins, rest = bins[: best[1]], best[2]
    rest = rest or []
    lower = lower or (least_sequences(histogram, capacity) if histogram else 0.0)
    return bins + rest, {"bound": lower, "rounded": sum(n for n, _ in bins), "filled": sum(n for n, _ in rest)}


def runs(bins: list[tuple[int, Counter]]) -> dict[str, np.ndarray]:
    """For each length the ranks that each configuration takes, sorted by length and rank."""
    rows, rank, sequence = [], Counter(), 0
    for n, config in bins:
        offset = 0
        for length, copies in config.items():
            rows.append((length, rank[length], copies, sequence, offset))
            rank[length] += n * copies
            offset += length * copies
        sequence += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T, strict=True))


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece its document, number, start, length and crc32 of its ids, and its sequence and offset there."""
    pieces = written(token_pieces(docs, path, capacity, end_id, doc_id, text), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = runs(plan(histogram, capacity)[0])
    salts = max(1, -(-max(histogram.values(), default=1) // GROUP))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("r", F.row_number().over(inside) - 1).join(counts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table["length"] << 40 | table["rank"] if len(table["rank"]) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            since = rank - table["rank"][at]
            sequence = table["sequence"][at] + since // table["copies"][at]
            offset = table["offset"][at] + since % table["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
