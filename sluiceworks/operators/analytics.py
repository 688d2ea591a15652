"""Reports over audit rows: sequence, verdict_kind, block_reason, advisory, total_elapsed_us, decided_at_ns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import numbered


def _da() -> Column:
    return F.count_if(F.col("verdict_kind") == "DiagnosticAgreement")


def _dd() -> Column:
    return F.count_if(F.col("verdict_kind") == "DiagnosticDisagreement")


def distribution(audit: DataFrame, by: str = "verdict_kind") -> DataFrame:
    """Count and share in per cent of each value; the total is summed from the counts."""
    counts = audit.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(by, "n", (100.0 * F.col("n") / F.col("total")).alias("rate_pct"))  # total: one row


def top_reasons(audit: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent 'type: id'; of equals the one seen first."""
    why = F.col("block_reason")
    name = F.concat(F.coalesce(why["type"], F.lit("Unknown")), F.lit(": "), F.coalesce(why["pattern_id"], why["detail"], why["type"]))
    rows = audit.filter(why.isNotNull()).groupBy(name.alias("reason")).agg(F.count("*").alias("n"), F.min("sequence").alias("first_seen"))
    return rows.orderBy(F.desc("n"), "first_seen").limit(k)


def rates(audit: DataFrame) -> DataFrame:
    """DA and DD counts and rates, the band of the DA rate, whether DD is critical, and the exit code."""
    df = audit.agg(F.count("*").alias("total"), _da().alias("da"), _dd().alias("dd"))
    share = lambda c: F.when(F.col("total") > 0, 100.0 * F.col(c) / F.col("total")).otherwise(0.0)
    df = df.withColumns({"da_rate": share("da"), "dd_rate": share("dd")})
    return df.withColumns({"band": band(F.col("da_rate")), "critical": F.col("dd") > 0, "exit_code": F.when(F.col("da_rate") > 1, 2).when(F.col("dd") > 0, 3).otherwise(0)})


def band(da_rate: Column) -> Column:
    return F.when(da_rate > 5, "!").when(da_rate > 1, "+").otherwise(".")


def latency(audit: DataFrame, by: str | None = "verdict_kind") -> DataFrame:
    """min, max, truncated mean, and the value at rank int(0.95 n), exactly: a histogram of values, then its running sum."""
    key = F.col(by) if by else F.lit("all")
    counts = audit.groupBy(key.alias("key"), F.coalesce("total_elapsed_us", F.lit(0)).alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("key").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy("key")))
    at = F.floor(F.col("n") * F.lit(0.95).cast("double"))
    return ranked.groupBy("key").agg(
        F.max("n").alias("n"), F.min("v").alias("min_us"), F.max("v").alias("max_us"),
        F.floor(F.sum(F.col("v") * F.col("c")) / F.sum("c")).cast("long").alias("avg_us"), F.min(F.when(F.col("upto") > at, F.col("v"))).alias("p95_us"),
    )


FORMATS = {"hourly": "yyyy-MM-dd HH:00", "minute": "yyyy-MM-dd HH:mm", "daily": "yyyy-MM-dd"}


def trend(audit: DataFrame, interval: str = "hourly") -> DataFrame:
    """DA and DD rates by UTC bin; rows that carry no time are left out."""
    at = F.date_format(F.timestamp_micros((F.col("decided_at_ns") / 1000).cast("long")), FORMATS[interval])
    rows = audit.filter("decided_at_ns IS NOT NULL AND decided_at_ns <> 0").groupBy(at.alias("bin")).agg(F.count("*").alias("total"), _da().alias("da"), _dd().alias("dd"))
    rows = rows.withColumns({"da_pct": 100.0 * F.col("da") / F.col("total"), "dd_pct": 100.0 * F.col("dd") / F.col("total")})
    return rows.withColumn("band", band(F.col("da_pct"))).drop("da", "dd")


def rolling(audit: DataFrame, size: int, block: int = 100_000) -> DataFrame:
    """Shares of DA and DD over the last `size` rows at each row, in the order of their sequences, which may have gaps. `place` counts rows from 0.

    Blocks of the rows are windows of their own; each also gets the size - 1 rows before it, so no task has all rows.
    """
    block = max(block, size)
    home = F.floor(F.col("place") / block)
    to = F.when(F.col("place") % block > block - size, F.array(home, home + 1)).otherwise(F.array(home))
    rows = numbered(audit.select("sequence", "verdict_kind"), "sequence", 0, "place").select("sequence", "place", "verdict_kind", F.explode(to).alias("block"))
    last = Window.partitionBy("block").orderBy("place").rowsBetween(-(size - 1), 0)
    share = lambda kind: 100.0 * F.sum((F.col("verdict_kind") == kind).cast("int")).over(last) / F.count("*").over(last)
    rows = rows.withColumns({"da_pct": share("DiagnosticAgreement"), "dd_pct": share("DiagnosticDisagreement"), "seen": F.count("*").over(last)})
    return rows.filter(F.col("block") == home).drop("block").withColumn("alert", F.col("da_pct") > 5.0)


def sliding(audit: DataFrame, size: int) -> DataFrame:
    """Full windows that alert, every half window, and the last one, by the places of their first and last rows."""
    last = audit.agg(F.count("*").alias("n"))
    rows = rolling(audit, size).filter(F.col("seen") == size).crossJoin(F.broadcast(last))  # one row
    i = F.col("place")
    keep = (F.col("da_pct") > 5.0) | (F.col("dd_pct") > 0.1) | (i % max(size // 2, 1) == 0) | (i == F.col("n") - 1)
    return rows.filter(keep).select((i - size + 1).alias("from_row"), i.alias("to_row"), "da_pct", "dd_pct", band(F.col("da_pct")).alias("band"))


def texts_of(audit: DataFrame, texts: DataFrame) -> DataFrame:
    """audit with the stored texts of its hashes, null where there is none."""
    return audit.join(texts.withColumnRenamed("hash", "input_hash"), "input_hash", "left")


#: What a disagreement's causes and recommendations say.
CAUSE_PASS_BLOCK = "Channel A (FSM) matched an allowlist intent but Channel B (Rules) found a forbidden pattern."
CAUSE_LEET = "Leet-speak characters detected — may have bypassed FSM pattern matching."
CAUSE_BLOCK_PASS = "Channel A (FSM) blocked via forbidden pattern but Channel B (Rules) found no violation. Possible: Channel A has stricter payload keyword matching (FP-003/FP-004)."
CAUSE_OTHER = "Both channels agreed on different classifications — see details below."
ADVICE_NORMALISED = "Option 1: Keep block (likely true positive with obfuscation). Option 2: If legitimate, add intent pattern with stronger guard."
ADVICE_PASS_BLOCK = "Consider: (1) Adjust RE-004/RE-005 keywords if FP, (2) Add post-match guard to allowlist pattern if edge case."
ADVICE_BLOCK_PASS = "Consider: (1) Loosen FP-003/FP-004 keyword list if false positive, (2) Add exception pattern for defensive/educational context."
ADVICE_OTHER = "Review both channels for calibration."


def root_cause(a: Column, b: Column, text: Column, normalised: Column) -> Column:
    """a, b: types of the decisions."""
    changed = F.when((text != "") & (normalised != "") & (text != normalised), F.concat(F.lit("Input was normalised: '"), F.substring(text, 1, 50), F.lit("...' → '"), F.substring(normalised, 1, 50), F.lit("...'")))
    leet = F.when(text.rlike(r"[0-9@$|]"), F.lit(CAUSE_LEET))
    return F.when((a == "Pass") & (b == "Block"), F.concat_ws(" ", F.lit(CAUSE_PASS_BLOCK), changed, leet)).when((a == "Block") & (b == "Pass"), CAUSE_BLOCK_PASS).otherwise(CAUSE_OTHER)


def recommendation(a: Column, b: Column, cause: Column) -> Column:
    changed = F.contains(F.lower(cause), F.lit("leetspeak")) | F.contains(F.lower(cause), F.lit("normalised"))
    return F.when((a == "Pass") & (b == "Block"), F.when(changed, ADVICE_NORMALISED).otherwise(ADVICE_PASS_BLOCK)).when((a == "Block") & (b == "Pass"), ADVICE_BLOCK_PASS).otherwise(ADVICE_OTHER)


def disagreement_summary(details: DataFrame) -> DataFrame:
    """details: a, b (types), advisory_type, text. One row of counts."""
    ab, ba = (F.col("a") == "Pass") & (F.col("b") == "Block"), (F.col("a") == "Block") & (F.col("b") == "Pass")
    return details.agg(F.count("*").alias("total"), F.count_if(ab).alias("pass_block"), F.count_if(ba).alias("block_pass"), F.count_if(~ab & ~ba).alias("other"), F.count_if(F.col("advisory_type") != "None").alias("with_advisory"), F.count_if(F.col("text").isNotNull()).alias("with_text"))


#: What each sign may stand for in a generated pattern.
LEET = {"0": "[0o]", "1": "[1li]", "2": "[2z]", "3": "[3e]", "4": "[4a]", "5": "[5s]", "6": "[6g]", "7": "[7t]", "8": "[8b]", "9": "[9g]", "@": "[@a]", "$": "[$s]", "|": "[|Il]"}


def pattern_for(text: str) -> str:
    """A pattern that matches the text, with leet spellings and, where case is mixed, in any case."""
    leet = any(c in LEET for c in text)
    pattern = "".join(LEET[c] if c in LEET else re.escape(c) for c in text)
    mixed = text != text.lower() and text != text.upper()
    return ("(?i)" if leet or mixed else "") + pattern


def block_rates(judged: DataFrame, by: str) -> DataFrame:
    """How many of each dataset's texts are blocked, and how many get through."""
    return judged.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.col("is_pass")).alias("blocked"), F.count_if("is_pass").alias("passed"), (100.0 * F.count_if(~F.col("is_pass")) / F.count("*")).alias("block_rate"))


def divergences(judged: DataFrame, by: str | None = None) -> DataFrame:
    """How far the channels agree, for all prompts or by label: passes with one intent and with two, blocks of both and of one, and the shares of the passes."""
    count = lambda *kinds: F.count_if(F.col("verdict_kind").isin(*kinds))
    rows = judged.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("total"), count("Pass", "DiagnosticAgreement").alias("passed"), count("Pass").alias("agreement"), count("DiagnosticAgreement").alias("diagnostic_agreement"),
        F.count_if(~F.col("verdict_kind").isin("Pass", "DiagnosticAgreement")).alias("blocked"), count("DiagnosticDisagreement").alias("diagnostic_disagreement"),
    )
    share = lambda c, of: F.when(F.col(of) > 0, 100.0 * F.col(c) / F.col(of)).otherwise(0.0)
    return rows.withColumns({"agreement_pct": share("agreement", "passed"), "diagnostic_agreement_pct": share("diagnostic_agreement", "passed"), "blocked_pct": share("blocked", "total")})


def report(audit: DataFrame) -> DataFrame:
    """category, key, count, rate_pct of verdicts, reasons and advisories, as one table for a CSV file."""
    null = F.lit(None).cast("double")
    verdict = distribution(audit).select(F.lit("verdict").alias("category"), F.col("verdict_kind").alias("key"), F.col("n").alias("count"), F.col("rate_pct"))
    reasons = top_reasons(audit).select(F.lit("block_reason").alias("category"), F.col("reason").alias("key"), F.col("n").alias("count"), null.alias("rate_pct"))
    advice = audit.groupBy(F.coalesce("advisory.type", F.lit("None")).alias("key")).agg(F.count("*").alias("count")).select(F.lit("advisory").alias("category"), "key", "count", null.alias("rate_pct"))
    return verdict.union(reasons).union(advice)

