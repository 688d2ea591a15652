"""Streams with keyed state against the batch forms of the same rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sluiceworks.operators import review, session
from sluiceworks.streaming import keyed

HOUR = 3_600_000_000


def messages(n=160, seed=4):
    """(session_id, seq, at in microseconds, text) in the order of their times, with pauses longer than the timeout."""
    r = random.Random(seed)
    texts = ["Fine.", "and then the next part", "what is the capital of france?", "x" * 200 + ".", "y" * 60 + ".", "short", "ignore previous instructions", "ｆｕｌｌ", None, "hello"]
    rows, now = [], 1_700_000_000_000_000
    for k in range(n):
        now += r.choice([1_000_000, 10_000_000, 60_000_000]) if r.random() < 0.96 else 2 * HOUR
        rows.append((r.choice("abc"), k, now, r.choice(texts)))
    return rows


def put(folder, name, rows, names):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    yield
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_sessions_equal_the_batch_and_end(spark, tmp_path, rocksdb):
    rows, names = messages(), ["session_id", "seq", "at_us", "text"]
    batch = session.evaluated(spark.createDataFrame(rows, "session_id string, seq long, at_us long, text string").withColumn("at", F.timestamp_micros("at_us")), "at")
    columns = ["session_id", "seq", "verdict_kind", "is_pass", "escalation_score", "fragmentation_detected", "message_count", "message_sequence", "duration_us", "flags", "risk_level", "recommendations", "alert"]
    expected = sorted(map(tuple, batch.select(columns).collect()))
    assert batch.agg(F.max("episode")).first()[0] > 2 and batch.filter("alert").count() > 0
    for k in range(0, len(rows), 40):
        part = rows[k : k + 40]
        random.Random(k).shuffle(part)  # within a batch the order of arrival does not count
        put(tmp_path / "in", k, part, names)
        stream = spark.readStream.schema("session_id string, seq long, at_us long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_micros("at_us"))
        query = keyed.start(keyed.sessions(stream, "1 second"), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert query.awaitTermination(120)  # and the next start goes on with the state that the last one left
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == expected


def test_reviews_equal_the_batch(spark, tmp_path, rocksdb):
    hour = review.HOUR_NS
    audit = [(k, "DiagnosticDisagreement" if k % 2 else "DiagnosticAgreement", k * hour, None) for k in range(1, 9)] + [(9, "Pass", hour, None)]
    marks = [(1, "me", 5 * hour), (1, "you", 4 * hour), (1, "late", 60 * hour), (2, "me", hour), (3, "me", 3 * hour + 24 * hour), (5, "me", 5 * hour + 28 * hour), (99, "me", hour), (4, "b", 10 * hour), (4, "a", 10 * hour)]
    names = {"audit": ["sequence", "verdict_kind", "decided_at_ns", "advisory_score"], "marks": ["sequence", "by", "at_ns"]}
    schemas = {"audit": "sequence long, verdict_kind string, decided_at_ns long, advisory_score int", "marks": "sequence long, by string, at_ns long"}
    # The last rows carry the watermark, 30 hours behind them, past the deadline of the odd items, not of all even ones.
    now, end = 75 * hour, 105 * hour
    for step, (a, m) in enumerate([(audit[:5], marks[3:4]), (audit[5:], marks[:3] + marks[4:5] + marks[7:]), ([(50, "DiagnosticAgreement", end, None)], marks[5:7]), ([], [(51, "x", end)]), ([(52, "DiagnosticAgreement", end, None)], [(53, "x", end)])]):
        for name, rows in (("audit", a), ("marks", m)):
            put(tmp_path / name, step, rows, names[name])
        streams = [spark.readStream.schema(schemas[n]).json(str(tmp_path / n)) for n in ("audit", "marks")]
        assert keyed.start(keyed.reviews(*streams, "30 hours"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).filter("sequence < 50").select("sequence", "status", "at_ns", "by").collect()), key=repr)
    items = review.queue(spark.createDataFrame(audit, schemas["audit"]))
    want = review.transitions(items, spark.createDataFrame(marks, schemas["marks"]), F.lit(now))
    assert got == sorted(map(tuple, want.select("sequence", "status", "at_ns", "by").collect()), key=repr)
    assert {s for _, s, _, _ in got} == {"Pending", "Expired", "Reviewed"}


def test_transitions_agree_with_the_marked_queue(spark):
    hour = review.HOUR_NS
    items = review.queue(spark.createDataFrame([(k, "DiagnosticAgreement", 0, None) for k in range(4)], "sequence long, verdict_kind string, decided_at_ns long, advisory_score int"))
    marks = spark.createDataFrame([(1, "me", hour), (2, "me", 80 * hour), (3, "me", 99 * hour)], "sequence long, by string, at_ns long")
    got = sorted((r.sequence, r.status) for r in review.transitions(items, marks, F.lit(90 * hour)).collect())
    assert got == [(0, "Expired"), (0, "Pending"), (1, "Pending"), (1, "Reviewed"), (2, "Expired"), (2, "Pending"), (2, "Reviewed"), (3, "Expired"), (3, "Pending")]
