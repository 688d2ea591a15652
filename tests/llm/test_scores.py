import duckdb
import pytest

from sluiceworks.llm import language_id, quality_classifier, quality_rules

from . import cases

SF = "/root/testdata/sf0.001"


def test_rules_equal_the_sql(spark):
    rows = cases.texts(40)
    got = {(r.doc_id, r.n_words): tuple(r) for r in quality_rules.quality_rules(cases.wide(spark, rows)).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [r for k, r in enumerate(rows) if r not in rows[:k]])
    sql = c.execute(quality_rules.oracle_sql()).fetchall()
    assert {(r[0], r[1]): tuple(r) for r in sql} == got


def test_repeated_words_count_each_word_once(spark):
    text = "a b c a b c a b c x y z"
    row = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (12, 9, True)


def test_rules_catch_junk_and_keep_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").filter("n_words >= 50").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_id(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_nothing_and_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    mixed = "the of and with this be or the of and to the " * 3 + "der die das und ist ein nicht mit auf für " * 3
    rows = [(1, None), (2, ""), (3, "123 %% 456"), (4, mixed), (None, "the and of"), (6, "Привет мир"), (7, "\u0301"), (8, "\u0301 12 \u0302"), (9, "the and of " * 9000), (9, "the and of " * 9000), (10, "xkq zwj vvq " * 40)]
    got = {r.doc_id: r for r in language_id.language_id(cases.wide(spark, rows), model).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in (1, 2, 3, 7, 8)] == [("und", 0)] * 5
    assert (got[None].lang_pred, got[None].held_out, got[9].lang_pred) == ("en", False, "en")
    assert got[6].lang_pred != "und" and got[6].score == 0 and got[6].fit is None
    assert got[10].fit < -3 < got[9].fit
    assert language_id.language_id(cases.wide(spark, [(1, "x")]).limit(0), model).collect() == []
    spans = language_id.language_spans(cases.frame(spark, [(4, mixed)]), model).orderBy("span").collect()
    assert [s.lang for s in spans] == ["en", "de"]


def test_spans_are_the_best_path(spark):
    """Against all paths of short texts."""
    import itertools

    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = ["the und de la of", "der the", "", "le les und", "x"]
    words = language_id.cut(texts)
    scores, path = model.word_scores(words), model.spans(words, 3.0)
    for a, b in itertools.pairwise(words.texts.tolist()):
        value = lambda p, a=a: sum(scores[a + i, s] for i, s in enumerate(p)) - 3.0 * sum(x != y for x, y in itertools.pairwise(p))
        best = max((value(p) for p in itertools.product(range(len(model.languages)), repeat=b - a)), default=0)
        assert value(path[a:b].tolist()) == pytest.approx(best)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.language_id(docs, language_id.fit(docs)).first().lang_pred == "und"


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.quality_classifier(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 and (r.score >= 0.3) == (r.predicted == 1) for r in out)


def test_classifier_on_nothing(spark):
    docs = cases.wide(spark, [(1, None), (2, ""), (3, "some words"), (None, "x")])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_classifier.quality_classifier(docs, quality_classifier.fit(docs, labels)).collect()
    assert {r.score for r in out} == {0.5}
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    out = quality_classifier.quality_classifier(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(out) == 4


def test_classifier_votes_equal_brute_force(spark):
    """Every cosine and vote by itself, ties at the last neighbour included, for repeated, long and empty texts."""
    import math

    import numpy as np

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels.union(labels.selectExpr("doc_id", "1 - quality", "toxic").limit(3)))
    assert len(model.labels) == labels.filter(~quality_classifier.held_out(labels.doc_id)).select("doc_id").distinct().count()
    model.vectors[1::2] = model.vectors[::2][: len(model.vectors[1::2])]  # ties
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()] + [(1001, None), (1002, ""), (1003, "word " * 30_000), (1003, "word " * 30_000)]
    got = quality_classifier.quality_classifier(cases.wide(spark, rows), model).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        counts = quality_classifier.term_counts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        expected = model.prior
        if counts.any():
            x = model.embed(counts)[0]
            cosine = [float(np.float32(sum(float(a) * float(b) for a, b in zip(x, v, strict=True)))) for v in model.vectors]
            near = sorted(range(len(cosine)), key=lambda i: (-round(cosine[i], 5), i))[: quality_classifier.NEIGHBOURS]
            weights = [max(cosine[i], 0) ** quality_classifier.POWER for i in near]
            if sum(weights) > 0:
                expected = math.fsum(w * model.labels[i] for w, i in zip(weights, near, strict=True)) / math.fsum(weights)
        assert r.score == pytest.approx(expected, abs=2e-2)
        assert r.predicted == int(r.score >= 0.3)
    assert quality_classifier.quality_classifier(cases.wide(spark, rows).limit(0), model).collect() == []


def test_rules_of_no_rows(spark):
    assert quality_rules.quality_rules(cases.wide(spark, [(1, "x")]).limit(0)).collect() == []
