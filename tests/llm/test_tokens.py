import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluiceworks.llm import bpe, packing, ragged, token_counts
from sluiceworks.llm.shared import new_path

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "'re", "'S", "é", "ß", "1", "२", "!", ".", " \n", "\t", "\r\n", "日本", "😀", "<|endoftext|>", "\x85", "\x1c", "aaa", "'d'", "²", "́", "​", "ab" * 20]


def strange(n=300):
    r = random.Random(4)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", "<|endoftext|>", "a" * 3000]


@pytest.mark.parametrize("kind", [bpe.Bpe, bpe.RoundBpe])
def test_ids_are_those_of_the_library(kind):
    library, own, texts = Tokenizer.from_file(PATH), kind(PATH), strange()
    ids, at = own.encode(texts)
    for x, a, b in zip(texts, at, at[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(x, add_special_tokens=False).ids, x


def test_query_digests(spark):
    library = Tokenizer.from_file(PATH)
    rows = [*cases.texts(20), *((1000 + i, x) for i, x in enumerate(strange(60)))]
    got = {r.doc_id: r for r in bpe.bpe_round_trip(cases.wide(spark, rows), PATH).collect()}
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_decode_to_the_text(spark):
    rows = [(i, x) for i, x in enumerate(strange(40))]
    ids = bpe.bpe_ids(cases.frame(spark, rows), PATH)
    assert {r.doc_id: r.text for r in bpe.bpe_texts(ids, PATH).collect()} == dict(rows)


def test_packing_places_every_piece_once(spark):
    library = Tokenizer.from_file(PATH)
    rows = cases.texts(60)
    out = packing.best_fit_packing(cases.wide(spark, rows), PATH).collect()
    expected = Counter()
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cut = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            expected[(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= -(-sum(r.length for r in out) // 2048) + 2


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_histogram_and_is_short(seed):
    r = random.Random(seed)
    histogram = Counter(min(64, int(r.expovariate(0.08)) + 1) for _ in range(3000))
    bins, figures = packing.plan(dict(histogram), 64)
    held = Counter()
    for n, config in bins:
        assert sum(k * c for k, c in config.items()) <= 64
        for k, c in config.items():
            held[k] += n * c
    assert held == histogram
    least = -(-sum(k * n for k, n in histogram.items()) // 64)
    assert figures["bound"] <= sum(n for n, _ in bins) <= least * 1.01 + 2
    assert sum(n for n, _ in bins) == figures["rounded"] + figures["filled"]


@pytest.mark.parametrize(("histogram", "least"), [({700: 1000}, 500), ({1500: 100, 400: 100}, 100), ({1300: 50, 700: 60}, 55), ({2048: 3}, 3)])
def test_plan_where_no_sequence_is_full(histogram, least):
    bins, figures = packing.plan(histogram)
    assert sum(n for n, _ in bins) == least and figures["filled"] == 0 and figures["bound"] > least - 1


def test_plan_of_a_histogram_that_no_setting_was_chosen_on():
    r = random.Random(77)
    histogram = Counter(min(2048, int(r.paretovariate(0.9) * 60)) for _ in range(30_000))
    bins, figures = packing.plan(dict(histogram))
    held = Counter()
    for n, config in bins:
        held.update({k: n * c for k, c in config.items()})
    assert held == histogram
    assert sum(n for n, _ in bins) <= figures["bound"] * 1.001 + 1


def test_words_of_a_letter_sequence_and_its_complement():
    """Doubling words of a and b, on which polynomial hashes modulo powers of two collide."""
    library, t = Tokenizer.from_file(PATH), "a"
    for _ in range(12):
        t += t.translate({97: 98, 98: 97})
    texts = [x for k in (1024, 2048, 4096) for x in (t[:k], t[:k].translate({97: 98, 98: 97}))]
    for kind in (bpe.Bpe, bpe.RoundBpe):
        ids, at = kind(PATH).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_do_not_depend_on_the_hash(monkeypatch):
    """Pieces whose hashes collide are told apart by their bytes."""
    whole = ragged.SpanHash.__call__
    monkeypatch.setattr(ragged.SpanHash, "__call__", lambda self, a, b, seed=0: whole(self, a, b, seed) & np.uint64(3 if not seed else 255))
    library, texts = Tokenizer.from_file(PATH), ["Some words, and some other words.", "", "don't 123 words" * 9]
    ids, at = bpe.Bpe(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_round_trip_of_an_empty_table(spark):
    assert bpe.bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_knapsack_is_best_on_small_cases():
    r = random.Random(2)
    for _ in range(40):
        lengths = np.array(sorted(r.sample(range(1, 12), 4)))
        value = np.array([r.random() for _ in lengths])
        best = packing.Knapsack(lengths, value, 15).chosen(15)

        def most(room, lengths=lengths, value=value):
            return max([0.0, *(v + most(room - k) for k, v in zip(lengths.tolist(), value.tolist(), strict=True) if k <= room)])

        assert sum(value[lengths.tolist().index(k)] * c for k, c in best.items()) == pytest.approx(most(15))


def test_empty_packing(spark):
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_rollup_follows_inserts_deletes_and_revisions_once(spark):
    rollup = token_counts.TokenRollup(spark, new_path(spark, "rollup"))
    kind = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    first = [("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", "b", None, "t1", 7, None), ("insert", "c", "de", "t1", 1, None)]
    assert rollup.totals().collect() == []
    assert rollup.apply("1", spark.createDataFrame(first, kind))
    assert not rollup.apply("1", spark.createDataFrame(first, kind))
    assert rollup.apply("2", spark.createDataFrame([("revise", "a", "en", "t1", 12, 10), ("delete", "c", "de", "t1", 1, None), ("insert", "a", "en", "t2", 3, None)], kind))
    assert rollup.apply("3", spark.createDataFrame([], kind))
    got = {tuple(r) for r in rollup.totals().collect()}
    assert got == {("a", "en", "t1", 2, 17), ("b", None, "t1", 1, 7), ("a", "en", "t2", 1, 3)}


def test_uncommitted_batch_does_not_count(spark):
    path = new_path(spark, "rollup")
    rollup = token_counts.TokenRollup(spark, path)
    kind = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    rollup.apply("1", spark.createDataFrame([("insert", "a", "en", "t", 1, None)], kind))
    stray = token_counts.signed(spark.createDataFrame([("insert", "a", "en", "t", 50, None)], kind)).selectExpr("*", "0L AS generation", "'2' AS batch_id")
    stray.write.mode("append").partitionBy("generation", "batch_id").parquet(rollup.deltas)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 1)]
    rollup.apply("2", spark.createDataFrame([("insert", "a", "en", "t", 4, None)], kind))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 2, 5)]


def test_rollup_of_a_table_counts_every_row(spark):
    library, rows = Tokenizer.from_file(PATH), cases.texts(30)
    out = token_counts.rollup_of(cases.wide(spark, rows), new_path(spark, "rollup"), PATH, "v1").collect()
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert [tuple(r) for r in out] == [("s", "en", "v1", len(rows), total)]


def test_a_table_comes_in_by_batches_that_change_it(spark):
    """The batches do change counts on their way, and end at a plain recount."""
    rows = [(k, "w%d " % k * (k % 40)) for k in range(200)] + [(None, "x y"), (3, None)]
    docs = cases.wide(spark, rows)
    counts = token_counts.token_counts(docs, PATH, "v1").cache()
    batches = token_counts.batches_of(counts)
    rollup, seen = token_counts.TokenRollup(spark, new_path(spark, "rollup"), fold=2), []
    for batch_id, changes in batches:
        assert changes.count() > 5 and rollup.apply(batch_id, changes) and not rollup.apply(batch_id, changes)
        seen.append(tuple(rollup.totals().first()))
    n, total = counts.count(), counts.agg({"n_tokens": "sum"}).first()[0]
    assert [b for b, _ in batches] == ["load", "withdrawn", "counted", "returned"] and len(set(seen)) == 4
    assert seen[-1][-2:] == (n, total) == (len(rows), sum(len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) for _, t in rows))
    assert seen[1][-2] < n


def test_totals_that_are_not_read_yet_outlive_a_fold(spark):
    rollup = token_counts.TokenRollup(spark, new_path(spark, "rollup"), fold=2)
    kind = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    one = spark.createDataFrame([("insert", "a", "en", "t", 10, None)], kind)
    rollup.apply("1", one)
    before = rollup.totals()
    rollup.apply("2", one)
    assert rollup.generation() == 1 and [tuple(r)[-2:] for r in before.collect()] == [(1, 10)]
    assert [tuple(r)[-2:] for r in rollup.totals().collect()] == [(2, 20)]


def test_rollup_folds_and_still_knows_old_batches(spark):
    rollup = token_counts.TokenRollup(spark, new_path(spark, "rollup"), fold=2)
    kind = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    for k in range(5):
        assert rollup.apply(str(k), spark.createDataFrame([("insert", "a", None, "t", 10, None), ("insert", f"s{k}", "en", "t", 1, None), ("delete", f"s{k - 1}", "en", "t", 1, None)], kind))
    assert rollup.generation() == 2 and not rollup.apply("0", spark.createDataFrame([("insert", "a", None, "t", 10, None)], kind))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", None, "t", 5, 50), ("s-1", "en", "t", -1, -1), ("s4", "en", "t", 1, 1)}


def _best_fit(histogram, capacity):
    """Best fit decreasing, piece by piece."""
    import bisect

    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = bisect.bisect_left(rooms, length)
            room = rooms.pop(i) - length if i < len(rooms) else capacity - length
            bisect.insort(rooms, room)
    return len(rooms)


@pytest.mark.parametrize("kind", ["uniform", "narrow", "middle", "peaks"])
def test_plan_against_best_fit(kind):
    r = np.random.default_rng(3)
    lengths = {
        "uniform": lambda: r.integers(1, 2049, 20_000), "narrow": lambda: r.integers(600, 760, 20_000), "middle": lambda: r.integers(200, 1025, 20_000),
        "peaks": lambda: np.clip(np.concatenate([r.normal(300, 40, 10_000), r.normal(900, 100, 5_000)]), 1, 2048).astype(int),
    }[kind]()
    histogram = Counter(lengths.tolist())
    bins, figures = packing.plan(dict(histogram), 2048)
    held = Counter()
    for n, config in bins:
        assert sum(k * a for k, a in config.items()) <= 2048
        for k, a in config.items():
            held[k] += n * a
    total = sum(n for n, _ in bins)
    assert held == histogram and total >= figures["bound"] - 1e-6 and figures["rounded"] > 0
    assert total <= 1.001 * _best_fit(histogram, 2048)


def test_tiny_histograms_take_no_time():
    import time

    began = time.perf_counter()
    assert sum(n for n, _ in packing.plan({1: 3}, 2048)[0]) == 1
    assert sum(n for n, _ in packing.plan({2048: 10**6}, 2048)[0]) == 10**6
    assert packing.plan({}, 2048)[0] == []
    assert time.perf_counter() - began < 1


def test_rollup_of_no_rows(spark):
    assert token_counts.rollup_of(cases.wide(spark, [(1, "x")]).limit(0), new_path(spark, "rollup"), PATH, "v1").collect() == []
