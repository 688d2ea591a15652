from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from sluiceworks.llm import jaccard_join, quality_rules

from . import cases

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "jaccard_join", "suffix_array_dedup", "best_fit_packing"]


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, docs
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.collect()}
        at = spark.createDataFrame(stage(spark, at, SF).collect(), docs.schema)
        after = {r.doc_id: r.text for r in at.collect()}
        assert at.columns == columns and set(after) <= set(before)
        if name == "quality_rules":
            assert set(after) == kept
        if name == "language_id":
            assert after == before
        if name == "jaccard_join":
            component = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect()}
            assert set(after) == set(component.values())
            assert max(Counter(component[d] for d in after).values()) == 1
        if name == "suffix_array_dedup":
            assert set(after) == set(before) and all(len(after[d]) <= len(before[d]) for d in after)
    assert corpus_pipeline.run(spark, SF).count() >= at.count()


def test_stages_take_nulls_repeats_long_texts_and_clashing_names(spark):
    """Rules, language, classes and repeats of the whole chain against plain statements of them on a small table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [r.text for r in docs.limit(60).collect() if len(r.text.split()) > 80][:12]
    rows = [(k, t) for k, t in enumerate(clean, 10)] + [(40, clean[0]), (41, clean[1] + " one more"), (41, clean[1] + " one more"), (1, None), (2, ""), (None, clean[2]), (3, "αβγ δεζ " * 50), (4, " ".join(clean) * 30)]
    at = cases.wide(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = at.columns
        at = spark.createDataFrame(stage(spark, at, SF).collect(), at.schema)
        ids = [r.doc_id for r in at.collect()]
        assert at.columns == columns and None not in ids
        if name == "language_id":
            assert not {1, 2, 3} & set(ids)
        if name == "jaccard_join":
            assert len(ids) == len(set(ids)) and not {40, 41} & set(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {p.doc_id for p in pieces} == set(ids)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = spark.createDataFrame(stage(spark, empty, SF).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).collect() == []
