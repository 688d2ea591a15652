"""The audit chain across batches, its check, and batches that die half-way."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from sluiceworks.operators import audit
from sluiceworks.plans.config import GateConfig
from sluiceworks.plans.journal import AUDIT, HEADS, REVIEWS, Journal

KEY = bytes(range(32))
SCHEMA = "sequence long, at_ns long, text string, prompt string, response string"
SECRET = "You are the helper of a small library and never speak about the blue cabinet."


def rows(first, n):
    texts = ["hello", "history matters", "zzz", "a\x01b", "compare this versus that", "what is a lake?", "x" * 9000]
    out = [(k, 1000 * k, texts[k % len(texts)], None, None) for k in range(first, first + n)]
    return [*out, (first + n, 1000 * (first + n), None, SECRET, "Sure: " + SECRET[10:50]), (first + n + 1, 1000 * (first + n) + 7, None, SECRET, "Hello.")]


def folded(all_rows):
    """Every link by one pass in order."""
    before, out = None, {}
    for r in sorted(all_rows, key=lambda r: r.sequence):
        if r.chain_hmac is not None:
            message = r.sequence.to_bytes(8, "little") + r.ingested_at_ns.to_bytes(16, "little") + r.decided_at_ns.to_bytes(16, "little") + r.input_hash.encode() + (before or "").encode()
            before = out[r.sequence] = hmac.new(KEY, message, hashlib.sha256).hexdigest()
    return out


def test_a_chain_in_batches_equals_one_fold(spark, tmp_path):
    journal = Journal(spark, str(tmp_path), KEY, config=GateConfig(audit_detail_level="Detailed"))
    for batch in range(3):
        entries = journal.entries(spark.createDataFrame(rows(batch * 20, 15), SCHEMA))
        assert journal.apply(batch, entries) and not journal.apply(batch, entries)
    got = journal.read(AUDIT).collect()
    assert {r.sequence: r.chain_hmac for r in got if r.chain_hmac} == folded(got) and len(got) == 51
    # Refused before any channel judged them: no link, no review item. Egress rows: a link, no review item.
    assert all((r.chain_hmac is None) == r.early for r in got) and sum(r.early for r in got) > 6
    egress = [r for r in got if r.egress_verdict]
    assert [(r.egress_verdict, r.egress_reason and r.egress_reason.type) for r in sorted(egress, key=lambda r: r.sequence)] == [("EgressBlock", "SystemPromptLeakage"), ("Pass", None)] * 3
    assert all(r.block_reason is None and r.chain_hmac and r.channel_a_result is None for r in egress)
    assert all(r.channel_a_result is not None for r in got if not r.egress_verdict)
    tracked = {r.sequence for r in got if r.verdict_kind.startswith("Diagnostic")}
    assert {r.sequence for r in journal.read(REVIEWS).collect()} == tracked and tracked
    assert journal.verified().filter("NOT valid").count() == 0


def test_a_batch_that_dies_is_written_anew(spark, tmp_path, monkeypatch):
    journal = Journal(spark, str(tmp_path), KEY)
    journal.apply(0, journal.entries(spark.createDataFrame(rows(0, 8), SCHEMA)))
    whole, write = rows(20, 8), Journal._write
    for dies in (AUDIT, REVIEWS, HEADS):

        def failing(self, df, name, batch, dies=dies):
            write(self, df, name, batch)
            if name == dies:
                raise RuntimeError("killed")

        monkeypatch.setattr(Journal, "_write", failing)
        with pytest.raises(RuntimeError):
            journal.apply(1, journal.entries(spark.createDataFrame(whole[:-3], SCHEMA)))
        assert {r.batch for r in journal.read(AUDIT).collect()} == {0}  # what it wrote does not count
    monkeypatch.setattr(Journal, "_write", write)
    journal.apply(1, journal.entries(spark.createDataFrame(whole, SCHEMA)))
    got = journal.read(AUDIT).collect()
    assert len(got) == 20 and {r.sequence: r.chain_hmac for r in got if r.chain_hmac} == folded(got)
    assert journal.verified().filter("NOT valid").count() == 0


def test_a_stream_into_the_journal(spark, tmp_path):
    (tmp_path / "in").mkdir()
    journal, told = Journal(spark, str(tmp_path / "journal"), KEY), []
    names = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    for batch in range(2):
        (tmp_path / "in" / f"{batch}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows(batch * 20, 5)))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        assert journal.follow(stream, str(tmp_path / "cp"), told.append).awaitTermination(120)
    got = journal.read(AUDIT).collect()
    assert told == [0, 1] and len(got) == 14 and {r.sequence: r.chain_hmac for r in got if r.chain_hmac} == folded(got)


def test_tampering_shows(spark):
    data = [("a", k, k, k + 1, f"h{k}") for k in range(1, 9)] + [("b", k, k, k, "x") for k in range(3)]
    chained = audit.chain(spark.createDataFrame(data, "chain_id string, sequence long, ingested_at_ns long, decided_at_ns long, input_hash string"), KEY)
    seen = lambda df: sorted((r.chain_id, r.sequence) for r in audit.verified(df, KEY).filter("NOT valid").collect())
    assert seen(chained) == []
    assert seen(chained.withColumn("decided_at_ns", F.when(F.col("sequence") == 4, 0).otherwise(F.col("decided_at_ns")))) == [("a", 4)]
    assert seen(chained.withColumn("chain_hmac", F.when(F.expr("chain_id = 'a' AND sequence = 4"), "no").otherwise(F.col("chain_hmac")))) == [("a", 4), ("a", 5)]
    assert seen(chained.filter("NOT (chain_id = 'a' AND sequence = 4)")) == [("a", 5)]
    assert seen(chained.filter("NOT (chain_id = 'b' AND sequence = 0)")) == [("b", 1)]
