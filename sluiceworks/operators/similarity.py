"""Edit-distance joins by an index of q-grams, and greedy leaders found in rounds: no pair is compared that shares no rare q-gram.
Where few leaders stand for many rows, each row is compared with these alone, as it is read, and nothing is shuffled.

Two texts of at most n letters with k edits between them share n - q + 1 - q k of their q-grams, each counted as often as it occurs. So with
every text's q-grams in one order, rare ones first, the first q k + 1 of one text have one in common with the first of the other. These
prefixes meet in a join; what meets and is of fitting length is compared by Spark's `levenshtein` with a bound. Texts that allow no edit only equal themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.edits import first_leaders, first_near
from ..sources.tables import kept, numbered, written

#: Texts that are compared with each other in the first round of leaders; every round takes twice as many.
BLOCK = 1024
#: The most leaders of a block that every row is compared with, and letters of the longest texts that are.
FEW, LETTERS = 64, 512
#: The most rows among which such leaders are looked for at once, and the share of the rows, one in so many, that they must settle if others are to be looked for.
WIDE, SHARE = 1 << 14, 16
#: Rows of q-grams sent on at once.
ROWS = 1 << 16


def shuffled(rows: DataFrame) -> DataFrame:
    """rows as a side of a join that is never broadcast: ids and q-grams are small on disk and large in the driver, and grow with the rows."""
    return rows.hint("merge")


def edits(n: Column | int, threshold: float) -> Column | int:
    """The most edits that leave a similarity of the threshold where the longer text has n letters."""
    exact = n * (1 - threshold) + 1e-9
    return F.floor(exact).cast("int") if isinstance(n, Column) else int(exact)


def gram_size(threshold: float, most: int = 3) -> int:
    """The greatest q for which texts of every length that allows an edit must share a q-gram."""
    fits = lambda q: (1 - threshold) * q < 1 and all(n - q + 1 - q * edits(n, threshold) > 0 for n in range(1, 1000) if edits(n, threshold))
    return max(q for q in range(1, most + 1) if q == 1 or fits(q))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / greater length; 1 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most > 0, 1.0 - F.levenshtein(a, b) / most).otherwise(1.0)


def grams(rows: DataFrame, q: int) -> DataFrame:
    """(id, n, gram) of rows (id, text): every q-gram with its number among equal ones, as 64 bits. A clash of hashes only adds candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column("text").to_pylist(), 0
            sizes, out = [], []
            for k, text in enumerate(texts):
                seen: Counter[str] = Counter()
                for i in range(len(text) - q + 1):
                    g = text[i : i + q]
                    seen[g] += 1
                    out.append(xxhash.xxh64_intdigest(f"{seen[g]} {g}") - (1 << 63))
                sizes.append(max(len(text) - q + 1, 0))
                if len(out) >= ROWS or k == len(texts) - 1:
                    rows_ = np.repeat(np.arange(start, k + 1), sizes)
                    n = np.repeat(np.array([len(t) for t in texts[start : k + 1]], dtype=np.int32), sizes)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows_)), pa.array(n), pa.array(out, pa.int64())], ["id", "n", "gram"])
                    sizes, out, start = [], [], k + 1

    return rows.select("id", "text").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n int, gram long")


def prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, n, gram) of the rare q-grams by which a text meets those it may be similar to; texts that allow no edit have none."""
    q = gram_size(threshold)
    rows = rows.filter(edits(F.ceil(F.length("text") / threshold), threshold) > 0)
    every = kept(grams(rows, q))
    common = every.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = every.join(shuffled(common), "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    return ordered.select("id", "n", F.explode(F.slice("g", F.lit(1), q * edits(F.col("n"), threshold) + 1)).alias("g")).select("id", "n", "g.gram")


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(shuffled(left.select(F.col("id").alias("a"), F.col("text").alias("x"))), "a").join(shuffled(right.select(F.col("id").alias("b"), F.col("text").alias("y"))), "b")
    most = F.greatest(F.length("x"), F.length("y"))
    both = both.withColumn("_k", edits(most, threshold)).withColumn("_d", F.expr("levenshtein(x, y, _k)")).filter("_d >= 0")
    return both.withColumn("similarity", 1.0 - F.col("_d") / most).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def meetings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of prefixes that share a q-gram and fit in length, each once."""
    x, y = left.select(F.col("id").alias("a"), F.col("n").alias("na"), "gram"), right.select(F.col("id").alias("b"), F.col("n").alias("nb"), "gram")
    fit = F.abs(F.col("na") - F.col("nb")) <= edits(F.greatest("na", "nb"), threshold)
    return x.join(shuffled(y), "gram").filter(fit & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def similar_pairs(rows: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """Pairs of rows with similar texts: a < b and their similarity. Null texts are similar to nothing; empty ones to each other.

    Different texts are compared once, however many rows have them."""
    rows = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")
    same = rows.select(F.col("id").alias("a"), "text").join(shuffled(rows.select(F.col("id").alias("b"), "text")), "text").filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    # The least row of a text stands for it.
    first = rows.groupBy("text").agg(F.min("id").alias("id"))
    short = prefixes(first, threshold)
    found = _verified(meetings(short, short, threshold), first, first, threshold)
    member = rows.join(shuffled(first.withColumnRenamed("id", "first")), "text").select("first", "id")
    pairs = found.join(shuffled(member.select(F.col("first").alias("a"), F.col("id").alias("p"))), "a").join(shuffled(member.select(F.col("first").alias("b"), F.col("id").alias("q"))), "b")
    return same.union(pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity"))


def _settled(pairs: DataFrame, block: DataFrame) -> DataFrame:
    """(id, leader) of a block whose similar pairs (a < b) are known: who has no similar leader before itself leads.

    A round makes leaders of those left that have nobody before them, and members of those they are similar to; each
    member goes to its least leader, which is settled once everybody before it is."""
    left, done = kept(block.select("id")), None
    while not left.isEmpty():
        open_ = kept(pairs.join(shuffled(left.select(F.col("id").alias("a"))), "a", "left_semi").join(shuffled(left.select(F.col("id").alias("b"))), "b", "left_semi"))
        leaders = left.join(shuffled(open_.select(F.col("b").alias("id")).distinct()), "id", "left_anti")
        joined = open_.join(shuffled(leaders.select(F.col("id").alias("a"))), "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader")).withColumnRenamed("b", "id")
        now = kept(leaders.withColumn("leader", F.col("id")).union(joined))
        done = now if done is None else done.union(now)
        left = kept(left.join(shuffled(now), "id", "left_anti"))
    if done is None:
        return block.select("id", F.col("id").alias("leader"))
    # A member may be similar to a leader of a later round that stands before the one it was given to first.
    led = done.filter("id = leader").select(F.col("id").alias("a"))
    least = pairs.join(shuffled(led), "a", "left_semi").groupBy("b").agg(F.min("a").alias("least")).withColumnRenamed("b", "id")
    return done.join(shuffled(least), "id", "left").select("id", F.when(F.col("id") == F.col("leader"), F.col("id")).otherwise(F.least("leader", "least")).alias("leader"))


def _first_of(leaders: list[str], threshold: float) -> Callable[[Column], Column]:
    """The number of the first of some texts that a text is similar to, or null."""

    @F.arrow_udf(T.IntegerType())
    def near(text: pa.Array) -> pa.Array:
        at = first_near(text.to_pylist(), leaders, threshold)
        return pa.array(at, mask=at < 0)

    return near


def _led_by_few(rows: DataFrame, threshold: float, block: int, few: int) -> tuple[list[DataFrame], DataFrame | None]:
    """(o, leader) of those rows (o, text) that a few leaders settle, and the rows left, None if none are.

    The first leaders of the first rows lead whatever comes later, so each row joins the first of them that it is similar to; the rows left begin
    again with their own first, in a larger block. Goes on while few leaders settle one row in SHARE, in the block and then of all,
    so all passes together look at no more than SHARE times the rows. A text that is too long to be compared ends the leaders of its block."""
    done, kind = [], T.StructType([T.StructField("at", T.IntegerType()), T.StructField("leader", rows.schema["o"].dataType)])
    while True:
        # The first rows of each task meet in one, and only the block comes to the driver; of longer texts, as much as shows that they are.
        head = kept(rows.select("o", F.substring("text", 1, LETTERS + 1).alias("text")).orderBy("o", "text").limit(block)).orderBy("o", "text").collect()
        if not head:
            return done, None
        found, joined = first_leaders([r.text for r in head], threshold, few, int(LETTERS * threshold))
        if not found or len(found) == few and SHARE * joined < len(head):
            return done, rows
        at = _first_of([head[k].text for k in found], threshold)(F.when(F.length("text") <= LETTERS, F.col("text")).otherwise(""))
        seen = written(rows.withColumn("at", at).withColumn("text", F.when(F.col("at").isNull(), F.col("text"))), "leaders")
        heads = rows.sparkSession.createDataFrame([(i, head[k].o) for i, k in enumerate(found)], kind)
        done.append(seen.filter("at IS NOT NULL").join(F.broadcast(heads), "at").select("o", "leader"))  # at most few rows
        rows, block = seen.filter("at IS NULL").select("o", "text"), max(block, min(4 * block, WIDE))
        n, settled = seen.agg(F.count("*"), F.count("at")).first()
        if SHARE * settled < n:
            return done, rows


def leader_clusters(rows: DataFrame, order: str, text: str, threshold: float = 0.85, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(order, leader) of each row with a text: rows come in order, and each joins the first leader before it that it is similar to, or leads.

    Where few leaders stand for many rows, rows are compared with these as they are read; what is left, by q-grams. `leader` is the order of the cluster's first row."""
    rows = rows.select(F.col(order).alias("o"), F.col(text).alias("text")).filter("text <> '' AND o IS NOT NULL")
    done, left = _led_by_few(rows, threshold, block, few)
    parts = done if left is None else [*done, _led_in_blocks(left, threshold, block)]
    return reduce(DataFrame.union, parts or [rows.select("o", F.col("o").alias("leader"))]).select(F.col("o").alias(order), "leader")


def _led_in_blocks(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """(o, leader) of rows (o, text).

    Equal texts act alike, so each is settled once, by its first row. Texts are settled in blocks that double: a block is compared
    within itself, then everything later is compared with the block's leaders only and what is similar to one is settled too. So a family
    of many variants is never compared pair by pair."""
    texts = kept(numbered(rows.groupBy("text").agg(F.min("o").alias("first")), "first", 0, "id"))
    short, left, done, last, size = kept(prefixes(texts, threshold)), texts.select("id", "text"), None, 0, block
    while not left.isEmpty():
        last, size = last + size, 2 * size
        part, later = left.filter(F.col("id") < last), left.filter(F.col("id") >= last)
        mine = short.join(shuffled(part.select("id")), "id", "left_semi")
        now = kept(_settled(kept(_verified(meetings(mine, mine, threshold), part, part, threshold)), part))
        led = part.join(shuffled(now.filter("id = leader").select("id")), "id", "left_semi")
        leaders, others = short.join(shuffled(led.select("id")), "id", "left_semi"), short.join(shuffled(later.select("id")), "id", "left_semi")
        hit = _verified(meetings(leaders, others, threshold), led, later, threshold).groupBy("b").agg(F.min("a").alias("leader")).withColumnRenamed("b", "id")
        now = kept(now.union(hit))
        done = now if done is None else done.union(now)
        left = kept(later.join(shuffled(now), "id", "left_anti"))
    if done is None:
        return rows.select("o", F.col("o").alias("leader"))
    heads = texts.select(F.col("id").alias("leader"), F.col("first").alias("head"))
    named = done.join(shuffled(heads), "leader").join(shuffled(texts), "id").select("text", "head")
    return rows.join(shuffled(named), "text").select("o", F.col("head").alias("leader"))


def suspicious_clusters(clusters: DataFrame, order: str, k: int = 10) -> DataFrame:
    """Clusters of more than one row, the largest k, with an alert over five; of equals the one whose leader comes first."""
    counts = clusters.groupBy("leader").agg(F.count("*").alias("n")).filter("n > 1")
    return counts.orderBy(F.desc("n"), "leader").limit(k).withColumn("alert", F.col("n") > 5)
