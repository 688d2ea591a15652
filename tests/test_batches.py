"""What is sent through Python: each prompt once, and no more of it than counts."""

from pyspark.sql import functions as F

from sluiceworks import queries as gate
from sluiceworks.functions import vocab as V
from sluiceworks.functions.batches import SLICE, judgeable
from sluiceworks.functions.normalise import folded, fold, normalise, normalised

SF = "/root/testdata/sf0.001"
EDGE = V.MAX_BYTES


def test_a_prompt_goes_through_python_once(spark):
    for name in ("channel_a_structural", "advisory_scores", "channel_b_decisions"):
        plan = gate.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name


def test_long_texts_are_cut_and_judged_as_before(spark):
    texts = ["\r\n" * EDGE, "\r\n" * (EDGE + 1), "a" * EDGE, "a" * (EDGE + 1), "é" * EDGE, "x" * 500_000, "\r\n" * (EDGE - 3) + "abc" + "\r\n" * 9, None, "", "wo ist " + "x" * (EDGE - 8)]
    texts += ["t" + str(k) for k in range(SLICE * 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    assert df.select(F.max(F.length(judgeable("t")))).first()[0] == 2 * (EDGE + 1)
    rows = df.select("i", normalise("t").alias("n"), fold("t").alias("f")).orderBy("i").collect()
    assert [tuple(r.n) for r in rows] == [normalised(t) for t in texts]
    assert [r.f for r in rows] == [folded(t)[0] for t in texts]
