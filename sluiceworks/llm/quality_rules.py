"""Quality rules: a table of thresholds compiled into one projection of built-in column functions.

A null text has no words and fails the base rules, as an empty one does. Ties do not arise; repeated rows
get equal results, very long texts are judged whole, and an empty table gives no rows. Windows are told by 64-bit hashes. Columns of the input other than the id and the text are ignored. Aggregate or write the result before filtering on
it: Spark pushes a filter through the projection and would evaluate its array steps again inside each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and what counts as a symbol.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages that the stop-word rule speaks for.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "der", "die", "das", "und", "ist", "nicht", "ein", "zu", "le", "la", "les", "de", "et", "un", "une", "que", "el", "los", "las", "y", "en", "es", "del", "se"]


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= measure <= high; texts with fewer words than `from_words` are not asked."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The table. Measures are names of columns that `measures` adds.
RULES = [
    Rule("length", "n_words", low=50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("shouting", "shout_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.01, from_words=80),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
]


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with every measure the table may name."""
    t = F.col("_t")
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""))
    w, n = F.col("_w"), F.size("_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn("_h", windows)
    # Most texts repeat no window; only the others are sorted with their positions.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_g", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    g = F.col("_g")
    same = F.filter(g, lambda x, k: (F.when(k > 0, F.get(g, k - 1)["h"]) == x["h"]) | (F.get(g, k + 1)["h"] == x["h"]))
    df = df.withColumn("_p", F.coalesce(F.sort_array(F.transform(same, lambda x: x["i"])), F.array().cast("array<int>")))
    covered = F.aggregate(F.col("_p"), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        (F.length(t) - F.length(_without(t, "!"))).alias("_shouts"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("_stops"),
    )
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("_shouts") / words).alias("shout_ratio"),
        (F.col("_stops") / words).alias("stop_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))).alias("dup_line_ratio"),
    )


def passes(rule: Rule) -> Column:
    ok = F.lit(True)
    if rule.low is not None:
        ok &= F.col(rule.measure) >= rule.low
    if rule.high is not None:
        ok &= F.col(rule.measure) <= rule.high
    return ok | (F.col("n_words") < rule.from_words) if rule.from_words else ok


def quality_rules(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the base counts, base_failed, kept, and the name of the first rule it fails (null if none)."""
    first = F.coalesce(*[F.when(~passes(r), F.lit(r.name)) for r in rules])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measures(docs, doc_id, text).withColumns({"base_failed": base, "failed_rule": first})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def oracle_sql(rules: list[Rule] = RULES) -> str:
    """The same in DuckDB's SQL over the view `documents`."""
    blank = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    stops = ", ".join(f"'{x}'" for x in STOP_WORDS)

    def ok(r: Rule) -> str:
        parts = [f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)
        return f"(({' AND '.join(parts)}) OR n_words < {r.from_words})"

    first = "COALESCE(" + ", ".join(f"CASE WHEN NOT {ok(r)} THEN '{r.name}' END" for r in rules) + ")"
    return rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {blank}, '') <> '') AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(least(3, i - p)) AS n FROM (SELECT doc_id, i, lag(i, 1, -9) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(translate(t, {blank}, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, COALESCE(c.n, 0)::BIGINT AS n_repeat_words,
             len(l) AS lines, length(t) - length(translate(t, '!', '')) AS shouts,
             len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
q AS (SELECT *, n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word, n_symbols / greatest(n_words, 1) AS symbol_ratio,
             shouts / greatest(n_words, 1) AS shout_ratio, stops / greatest(n_words, 1) AS stop_ratio, n_dup_lines / greatest(lines, 1) AS dup_line_ratio FROM m),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {first} AS failed_rule FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rule IS NULL AS kept, failed_rule FROM f
"""
