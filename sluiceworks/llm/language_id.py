"""Language identification: script ranges narrow the candidates of a word, then Viterbi labels spans of words.

Each word (a run of letters and marks) gets a score per language from the character trigrams it holds. A path
through the words of a text may change the language at a fixed penalty; the best path labels the spans, and
the language with the most letters labels the text. `score` is the share of the text's letters that the path gives
it, in scripts that a learned language uses: a text in none of these has score 0. `fit` is the mean log-probability
of these letters under the labelling language less that of its training texts: far below 0 for a text in a language
that was not learned, and null where there are no such letters.

A text that is null or has no letter (marks alone are none) is `und` with score 0. Ties go to the language that sorts first. With
nothing to learn from (no labelled row) every text is `und`; an empty table gives no rows. Each row is judged by
itself, so repeated rows have equal results; whole texts are read, in runs of at least one text, and a very long
text is a run by itself. Columns besides the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, classes
from .ragged import chunks, mix

UNKNOWN = "und"
#: Trigram hashes; the size of the table per language.
BUCKETS = 1 << 16
#: Labelled rows that the model is fitted on at most, drawn by a hash of the id over the whole table.
FIT_ROWS = 20_000
#: Log-probability units that a change of language costs.
SWITCH = 12.0
CHUNK = 1 << 20

#: Ranges of code points by script; what is in none of them is script 0.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Hangul", 0xAC00, 0xD7AF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x2FA1F),
]
NAMES = list(dict.fromkeys(name for name, _, _ in SCRIPTS))


def script_of(cps: np.ndarray) -> np.ndarray:
    """1 + the place of the script in NAMES, or 0."""
    ranges = sorted((lo, hi, NAMES.index(name) + 1) for name, lo, hi in SCRIPTS)
    lo, hi, number = (np.array(x) for x in zip(*ranges, strict=True))
    at = np.maximum(np.searchsorted(lo, cps, side="right") - 1, 0)
    return np.where((cps >= lo[at]) & (cps <= hi[at]), number[at], 0)


def lower(text: str) -> str:
    """Lower case without changes of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """The words of a run of texts: trigram buckets in a row, and for each word its place, text, length and script."""

    grams: np.ndarray
    start: np.ndarray  # of the word's grams
    count: np.ndarray
    texts: np.ndarray  # words per text, as n + 1 offsets
    script: np.ndarray


def cut(texts: list[str]) -> Words:
    joined = lower(" ".join([*texts, ""]))  # a blank after every text
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    letter = classes()[cps] == LETTER
    inside = letter | (cps >= 0x300) & (cps <= 0x36F)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # Marks without a letter are no word.
    upto = np.append(0, np.cumsum(letter))
    lettered = upto[end] > upto[start]
    if not lettered.all():
        for a, b in zip(start[~lettered].tolist(), end[~lettered].tolist(), strict=True):
            inside[a:b] = False
        start, end = start[lettered], end[lettered]
    # The gram at a letter is the letter with its neighbours; what is not in the word counts as a blank.
    x = np.where(inside, cps, 32).astype(np.uint64)
    around = np.concatenate([[32], x, [32]]).astype(np.uint64)
    grams = (mix((around[:-2] * np.uint64(0x110000) + around[1:-1]) * np.uint64(0x110000) + around[2:]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return Words(grams[inside], np.cumsum(end - start) - (end - start), end - start, np.searchsorted(start, np.append(0, ends)), script_of(cps[start]))


@dataclass
class Model:
    """log[bucket, language] and which languages use a script: allowed[script, language]."""

    languages: list[str]
    log: np.ndarray
    allowed: np.ndarray
    usual: np.ndarray  # mean log of a training letter by language

    def word_scores(self, words: Words) -> np.ndarray:
        """One row per word. A script of no language leaves all candidates level."""
        total = np.zeros((len(words.grams) + 1, len(self.languages)))
        np.cumsum(self.log[words.grams], axis=0, out=total[1:])
        scores = total[words.start + words.count] - total[words.start]
        allowed = self.allowed[words.script]
        scores[~allowed.any(1)] = 0
        return np.where(allowed | ~allowed.any(1, keepdims=True), scores, -1e6)

    def spans(self, words: Words, penalty: float = SWITCH) -> np.ndarray:
        """The language of every word on the best path of its text: many texts advance a word at a time together."""
        score, at = self.word_scores(words), words.texts
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        start, size = at[:-1][order], size[order]
        longest = int(size[0]) if len(size) else 0
        running = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than t words
        back = np.zeros(score.shape, dtype=np.int32)
        own = np.arange(len(self.languages), dtype=np.int32)
        value = np.zeros((len(size), len(self.languages)))
        for t in range(longest):
            k = int(running[t])
            here = start[:k] + t
            v = value[:k]
            if t:
                best = v.argmax(1)
                change = v[np.arange(k), best][:, None] - penalty
                switch = change > v
                back[here] = np.where(switch, best[:, None], own)
                v = np.where(switch, change, v)
            value[:k] = v + score[here]
        out = np.zeros(len(score), dtype=np.int32)
        state = np.zeros(len(size), dtype=np.int32)
        for t in range(longest - 1, -1, -1):
            k, more = int(running[t]), int(running[t + 1]) if t + 1 < longest else 0
            state[more:k] = value[more:k].argmax(1)  # these texts end here
            here = start[:k] + t
            out[here] = state[:k]
            state[:k] = back[here, state[:k]]
        return out

    def label(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the place of its language (-1: none), the share of letters it has, and how well they fit."""
        n, k = len(words.texts) - 1, len(self.languages)
        doc = np.repeat(np.arange(n), np.diff(words.texts))
        if not k:
            return np.full(n, -1), np.zeros(n), np.full(n, np.nan)
        place = doc * k + self.spans(words)
        total = np.bincount(doc, weights=words.count, minlength=n)
        known = self.allowed[words.script].any(1)
        letters = np.bincount(place, weights=words.count * known, minlength=n * k).reshape(n, k)
        best = letters.argmax(1)
        # The letters' logs under the labelling language, over words in scripts that any language uses.
        flat = np.repeat(best[doc] if len(doc) else doc, words.count)
        logs = np.append(0, np.cumsum(self.log[words.grams, flat]))
        own = np.bincount(doc, weights=(logs[words.start + words.count] - logs[words.start]) * known, minlength=n)
        read = np.bincount(doc, weights=words.count * known, minlength=n)
        fit = np.where(read > 0, own / np.maximum(read, 1) - self.usual[best], np.nan)
        return np.where(total > 0, best, -1), letters[np.arange(n), best] / np.maximum(total, 1), fit


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Learn from labelled documents outside the held-out third: trigram and script counts, summed by Spark."""
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(doc_id)))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < int(1_000_000 * rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language in pc.unique(batch.column("lang")).to_pylist():
                w = cut(batch.filter(pc.equal(batch.column("lang"), language)).column("text").to_pylist())
                sums = np.bincount(w.grams, minlength=BUCKETS + len(NAMES) + 1)
                sums[BUCKETS:] = np.bincount(w.script, weights=w.count, minlength=len(NAMES) + 1)
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["lang", "at", "n"])

    counted = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most a row per language and bucket
    languages = sorted(table["lang"].unique())
    sums = np.zeros((BUCKETS + len(NAMES) + 1, len(languages)))
    sums[table["at"], [languages.index(x) for x in table["lang"]]] = table["n"]
    grams, scripts = sums[:BUCKETS], sums[BUCKETS:]
    log = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    return Model(languages, log, scripts > 0.01 * scripts.sum(0), (grams * log).sum(0) / np.maximum(grams.sum(0), 1))


def language_id(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: held_out, lang_pred, score and fit."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in chunks(batches, "text", CHUNK):
            words = cut(pc.fill_null(batch.column("text"), "").to_pylist())
            best, score, fit = model.label(words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(fit, from_pandas=True)], ["doc_id", "held_out", "lang_pred", "score", "fit"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, fit double")


def language_spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans themselves: doc_id, number of the span, its language, and how many words and letters it has."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in chunks(batches, "text", CHUNK):
            words = cut(pc.fill_null(batch.column("text"), "").to_pylist())
            doc = np.repeat(np.arange(len(batch)), np.diff(words.texts))
            state = model.spans(words) if model.languages else np.zeros(len(doc), np.int32)
            new = np.append(True, (doc[1:] != doc[:-1]) | (state[1:] != state[:-1]))[: len(doc)]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(doc)))
            letters = np.add.reduceat(words.count, first) if len(first) else np.zeros(0, np.int64)
            number = np.arange(len(first)) - np.searchsorted(doc[first], doc[first]) if len(first) else first
            names = np.array([*model.languages, UNKNOWN], dtype=object)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[first])), pa.array(number, pa.int32()), pa.array(names[state[first] if model.languages else np.full(len(first), -1)], pa.string()), pa.array(size, pa.int64()), pa.array(letters, pa.int64())], ["doc_id", "span", "lang", "n_words", "n_letters"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, span int, lang string, n_words long, n_letters long")
