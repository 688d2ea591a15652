"""Findings of records in both versions, and the stream over growing files."""

import json
import random

import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from sluiceworks.operators import analytics, findings
from sluiceworks.sources import tail
from sluiceworks.streaming import gate_stream

DD = {"verdict_kind": "DiagnosticDisagreement", "decided_at_ns": 1_700_000_000_123_456_000, "input_hash": "h", "total_elapsed_us": 9}
BLOCK = {"type": "Block", "reason": "NoIntentMatch", "pattern_id": "RE-004"}


def detail(spark, records, texts=None):
    lines = spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in records], "value string")
    log, broken = findings.records(lines)
    return findings.details(log, texts), broken


def test_records_of_both_versions(spark):
    records = [
        {**DD, "sequence": 1, "block_reason": {"type": "ForbiddenPattern", "pattern_id": "P"}, "advisory": {"type": "Disagreement", "score": 4}},
        {**DD, "sequence": 2, "block_reason": "MalformedInput"}, {**DD, "sequence": 3, "block_reason": None}, {**DD, "sequence": 4}, {**DD, "sequence": 5, "block_reason": {"type": ""}},
        {**DD, "sequence": 6, "schema_version": 2, "channel_a_result": {"decision": {"type": "Pass"}}, "channel_b_result": {"decision": BLOCK, "elapsed_us": 3}},
        {**DD, "sequence": 7, "schema_version": 2, "channel_a_result": {"decision": {"type": "Fault"}}, "channel_b_result": None, "block_reason": {"detail": "x"}},
        {**DD, "sequence": 8, "schema_version": 2, "decided_at_ns": 0}, {**DD, "sequence": 9, "verdict_kind": "Pass"},
        "{broken", "[1, 2]", "7", "", "  ", {**DD, "sequence": 10, "schema_version": 2, "channel_a_result": {"decision": {"type": "Block"}}, "channel_b_result": {"decision": {"type": "Pass", "intent": "I", "pattern_id": "Q"}}},
    ]
    rows, broken = detail(spark, records)
    got = {r.sequence: r for r in rows.collect()}
    assert sorted(r.value for r in broken.collect()) == ["7", "[1, 2]", "{broken"] and set(got) == {*range(1, 9), 10}
    sides = {k: ((r.a.decision_type, r.a.decision_detail, r.a.matched_pattern, r.a.elapsed_us), (r.b.decision_type, r.b.decision_detail, r.b.matched_pattern, r.b.elapsed_us)) for k, r in got.items()}
    assert sides[1] == (("Block", "P", "P", 4),) * 2 and sides[2] == (("Block", "MalformedInput", None, 4),) * 2 and sides[3] == (("Block", "None", None, 4),) * 2
    assert sides[4] == (("Block", "Unknown", None, 4),) * 2 and sides[5] == (("Unknown", "", None, 4),) * 2
    assert sides[6] == (("Pass", "Unknown", None, 0), ("Block", "NoIntentMatch", "RE-004", 3))
    assert sides[7] == (("Block", "Fault: Unknown", None, 0), ("Block", "Unknown", None, 4)) and sides[10] == (("Block", "Unknown", None, 0), ("Pass", "I", "Q", 0))
    assert got[1].timestamp == "2023-11-14T22:13:20.123456+00:00" and got[8].timestamp == "unknown" and got[1].advisory_score == 4
    assert got[6].root_cause == "[Schema v2] (Full channel data available) " and got[8].root_cause == "[Schema v2] " and got[1].root_cause == analytics.CAUSE_OTHER
    assert got[6].recommendation == analytics.ADVICE_PASS_BLOCK and got[10].recommendation == analytics.ADVICE_BLOCK_PASS


def test_findings_with_texts_and_actions(spark, tmp_path):
    texts = spark.createDataFrame([("h", "r4w text", "raw text"), ("z", "other", "other")], "hash string, input_text string, normalised_text string")
    rows, _ = detail(spark, [{**DD, "sequence": 1, "block_reason": {"type": "F", "pattern_id": "P"}}, {**DD, "sequence": 2, "input_hash": "none", "block_reason": {"type": "F", "pattern_id": "P"}}, {**DD, "sequence": 3, "input_hash": "none"}], texts)
    assert [r.problem_text for r in findings.problem_text(rows).orderBy("sequence").collect()] == ["r4w text", "P", None]
    actions = spark.createDataFrame([(1, "defer", "later", "2024-01-01"), (1, "add_pattern", "now", "2024-01-02"), (3, "acknowledge", None, "2024-01-01")], "sequence long, action string, notes string, timestamp string")
    out = findings.findings(rows, actions)
    assert len(out.columns) == 14
    findings.export(out, str(tmp_path / "f"))
    back = {r.sequence: r for r in spark.read.json(str(tmp_path / "f")).collect()}
    assert [(back[k].operator_action, back[k].operator_notes) for k in (1, 2, 3)] == [("add_pattern", "now"), (None, ""), ("acknowledge", "")]
    assert tuple(findings.exit_code(actions).first()) == (3, 1, 3) and findings.exit_code(actions.filter("sequence = 3")).first().exit_code == 0
    assert set(findings.TUNING) < set(findings.ACTIONS)


def test_causes_and_advice(spark):
    """A's pass with B's block names what normalising changed and leet signs; the advice follows the cause."""
    rows = [("Pass", "Block", "h4ck", "hack"), ("Pass", "Block", "same", "same"), ("Pass", "Block", "Ｆull", "Full"), ("Block", "Pass", "h4ck", "hack"), ("Block", "Block", "x", "x")]
    df = spark.createDataFrame(rows, "a string, b string, t string, n string").withColumn("cause", analytics.root_cause(*map(F.col, "abtn")))
    got = df.withColumn("advice", analytics.recommendation(F.col("a"), F.col("b"), F.col("cause"))).collect()
    changed = " Input was normalised: '{}...' → '{}...'"
    assert [r.cause for r in got] == [analytics.CAUSE_PASS_BLOCK + changed.format("h4ck", "hack") + " " + analytics.CAUSE_LEET, analytics.CAUSE_PASS_BLOCK, analytics.CAUSE_PASS_BLOCK + changed.format("Ｆull", "Full"), analytics.CAUSE_BLOCK_PASS, analytics.CAUSE_OTHER]
    assert [r.advice for r in got] == [analytics.ADVICE_NORMALISED, analytics.ADVICE_PASS_BLOCK, analytics.ADVICE_NORMALISED, analytics.ADVICE_BLOCK_PASS, analytics.ADVICE_OTHER]


def test_divergences_without_a_pass(spark):
    row = analytics.divergences(spark.createDataFrame([("Block",), ("DiagnosticDisagreement",)], "verdict_kind string")).first()
    assert (row.total, row.passed, row.blocked, row.diagnostic_disagreement, row.agreement_pct, row.blocked_pct) == (2, 0, 2, 1, 0.0, 100.0)


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1000])
def test_ranges_give_every_line_once(tmp_path, size, monkeypatch):
    r = random.Random(size)
    text = b"".join(bytes(r.choice(b"ab\r") for _ in range(r.choice([0, 1, 2, 9, 40]))) + b"\n" for _ in range(60)) + b"unfinished"
    (tmp_path / "f").write_bytes(text)
    system, path = fs.LocalFileSystem(), str(tmp_path / "f")
    monkeypatch.setattr(tail, "BLOCK", 5)
    end = tail.whole_lines(system, path, len(text), 0)
    assert end == len(text) - len(b"unfinished")
    got = [x for a in range(0, end, size) for x in tail.lines_of(system, tail.Range(path, a, min(a + size, end), end))]
    want, at = [], 0
    for line in text[:end].split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_a_growing_log_alerts_as_the_batch_does(spark, tmp_path):
    path, size = tmp_path / "audit.ndjson", 7
    kinds = ["DiagnosticAgreement" if k % 9 in (0, 1) else "Pass" for k in range(60)]
    lines = [json.dumps({"sequence": k, "verdict_kind": v}) + "\n" for k, v in enumerate(kinds)]
    whole = "".join(lines)
    cuts = [0, 200, 1500, 1501, len(whole)]  # lines are cut in the middle: their second halves come later
    for a, b in zip(cuts, cuts[1:], strict=False):
        with path.open("a") as f:
            f.write(whole[a:b])
        stream = tail.audit_tail(spark, str(path)).withColumn("stream_id", F.lit("s"))
        out = gate_stream.rolling_alert(stream, size)
        assert out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.sequence, round(r.da_pct, 6), r.alert) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = analytics.rolling(spark.createDataFrame(list(enumerate(kinds)), "sequence long, verdict_kind string"), size)
    assert got == sorted((r.sequence, round(r.da_pct, 6), r.alert) for r in batch.collect()) and any(a for _, _, a in got)
