import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import evaluation, expansion, pair_scorer
from siftwell.plans import feedback_queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"\w+")
DOCS = [(1, "red fox runs far", "a"), (2, "Red fox, red dog", "b"), (3, None, "c"), (4, "", "d"), (5, "blue sea and the blue sky", "e"), (6, "fox fox den", "f")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, `query.id` string")


def test_feedback_is_that_of_plain_python(spark):
    ranked = [(9, 1, 3.0, 1), (9, 2, 1.0, 2), (9, 4, 1.0, 3), (8, 3, 2.0, 1), (7, 6, 0.0, 1)]
    got = expansion.feedback_terms(docs(spark), spark.createDataFrame(ranked, "query_id long, doc_id long, score double, rank int"), 3).collect()
    words = {i: WORD.findall((t or "").lower()) for i, t, _ in DOCS}
    all_words = Counter(w for ws in words.values() for w in ws)
    p = defaultdict(float)
    for i, s in ((1, 3.0), (2, 1.0)):
        for w in words[i]:
            p[w] += s / 5 / len(words[i])
    gain = {w: round(x * math.log(x / (all_words[w] / all_words.total())), 9) for w, x in p.items()}
    want = sorted((w for w in gain if gain[w] > 0), key=lambda w: (-gain[w], w))[:3]
    assert [(r.query_id, r.token, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(9, w, i + 1) for i, w in enumerate(want)]
    assert all(abs(r.gain - gain[r.token]) < 1e-8 for r in got)
    with pytest.raises(ValueError):
        expansion.feedback_terms(docs(spark), None, 0)


def test_only_found_texts_are_cut_into_words_for_feedback(spark, monkeypatch):
    """Of all texts only their words' counts are taken, once; what a query found is cut into words by itself. Without a broadcast of ids the rows are the same."""
    ranked = spark.createDataFrame([(9, 1, 3.0, 1), (9, 2, 1.0, 2), (8, 5, 2.0, 1)], "query_id long, doc_id long, score double, rank int")
    plans, put = {}, expansion.written
    monkeypatch.setattr(expansion, "written", lambda df, name: plans.setdefault(name, str(df._jdf.queryExecution().optimizedPlan())) and put(df, name))
    one = sorted(map(tuple, expansion.feedback_terms(docs(spark), ranked, 3).collect()))
    assert list(plans) == ["found_texts", "feedback", "word_counts"]
    assert "regexp" not in plans["found_texts"] and "Join LeftSemi" in plans["found_texts"] and plans["word_counts"].count("LogicalRDD") == 1
    assert "parquet" in plans["feedback"] and plans["feedback"].count("LogicalRDD") == 1  # the second is the ranking
    monkeypatch.setattr(expansion, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, expansion.feedback_terms(docs(spark), ranked, 3).collect())) == one and len(one) == 6


def test_expanded_weights(spark):
    own = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 3)], "query_id long, token string, qtf long")
    more = spark.createDataFrame([(1, "b", 0.2), (1, "z", 0.1)], "query_id long, token string, gain double")
    got = {(r.query_id, r.token): r.qtf for r in expansion.expanded(own, more).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 1.0, (1, "z"): 0.25, (2, "c"): 1.0}
    assert expansion.expanded(own, more.limit(0)).count() == 3


def test_no_documents_no_feedback(spark):
    ranked = spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    assert expansion.feedback_terms(docs(spark, []), ranked).count() == 0 == expansion.feedback_terms(docs(spark), ranked).count()


@pytest.mark.parametrize("most", [0, 100])
def test_shared_runs(spark, monkeypatch, most):
    monkeypatch.setattr(evaluation, "BROADCAST_ROWS", most)
    rows = [(1, "x a b c D e y a b c d e"), (2, "a b c d"), (3, None), (4, "a b c d x e"), (5, "a b c d e")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(7, "q a b c d e"), (8, "a b c d"), (9, None)], "query_id long, text string")
    assert sorted((r.query_id, r.doc_id) for r in evaluation.shares_run(own, asked).collect()) == [(7, 1), (7, 5)]
    each = own.crossJoin(asked.withColumnRenamed("text", "query")).withColumns({"_d": T.words("text"), "_q": T.words("query")}).where(evaluation.has_run_of(F.col("_d"), F.col("_q")))
    assert sorted((r.query_id, r.doc_id) for r in each.collect()) == [(7, 1), (7, 5)]


def test_features(spark):
    rows = [(1, "red fox runs", "the red fox", 4.0), (1, "red fox runs", None, 2.0), (2, "fox", "", None), (2, None, "fox", None), (3, "", None, 0.0)]
    made = pair_scorer.features(spark.createDataFrame(rows, "query_id long, query string, text string, score double"))
    got = [tuple(round(x, 6) for x in r.features) for r in made.orderBy("query_id", "query", "text").collect()]
    length = lambda d, q: round(math.log((d + 1) / (q + 1)), 6)
    assert sorted(got) == sorted([(0.666667, 0.5, 0.5, 1.0, 0.0), (0, 0, 0, 0.5, length(0, 3)), (0, 0, 0, 0, length(0, 1)), (0, 0, 0, 0, length(1, 0)), (0, 0, 1.0, 0, 0)])


def test_fit_ends_where_the_loss_is_flat(spark):
    rng = np.random.default_rng(5)
    truth = np.array([2.0, 4.0, 0.0, 1.0, -0.5])
    rows = []
    for q in range(60):
        x = rng.random((12, 5))
        for v, good in zip(x, x @ truth + rng.normal(0, 0.8, 12) > 4):
            rows.append((q, [float(a) for a in v], bool(good)))
    schema = "query_id long, features array<double>, relevant boolean"
    w = np.array(pair_scorer.fit(spark.createDataFrame(rows, schema).repartition(4)).weights)
    slope, pairs = np.zeros(5), 0
    for q in range(60):
        good = np.array([f for i, f, r in rows if i == q and r]).reshape(-1, 5)
        rest = np.array([f for i, f, r in rows if i == q and not r]).reshape(-1, 5)
        d = (good[:, None] - rest[None]).reshape(-1, 5)
        slope += (d / (1 + np.exp(d @ w))[:, None]).sum(0)
        pairs += len(d)
    assert np.abs(slope / pairs - pair_scorer.RIDGE * w).max() < 1e-6
    assert w[1] > w[0] > w[2] and w[4] < 0
    none = [(1, [0.0] * 5, True), (2, None, False), (3, [1.0] * 5, None)]
    assert pair_scorer.fit(spark.createDataFrame(none, schema)).weights == (0.0,) * 5


def test_told_apart_by_one_feature(spark):
    """Weights stay finite, and the feature decides."""
    rows = [(q, [float(g), 0.5, 0.5, 0.5, 0.5], g == 1) for q in range(9) for g in (0, 1)]
    fitted = pair_scorer.fit(spark.createDataFrame(rows, "query_id long, features array<double>, relevant boolean"))
    assert 1 < fitted.weights[0] < 20 and np.allclose(fitted.weights[1:], 0)
    scores = [r.s for r in spark.createDataFrame([([0.0, 0.5, 0.5, 0.5, 0.5],), ([1.0, 0.5, 0.5, 0.5, 0.5],)], "features array<double>").select(fitted.score().alias("s")).collect()]
    assert 0 < scores[0] < scores[1] < 1


def test_query_ranks_by_its_fitted_scores(spark):
    """fitted_rerank's order is that of scores computed here from the same candidates and weights fitted without held-out ones."""
    own = feedback_queries._described(spark, SF).cache()
    w = np.array(feedback_queries._fitted(own).weights)
    rows = own.collect()
    assert {r.query_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") % 100 == 0).collect()}
    want = {}
    for q in {r.query_id for r in rows}:
        scored = sorted((-round(float(1 / (1 + np.exp(-np.dot(w, r.features)))), 6), r.doc_id) for r in rows if r.query_id == q)[:10]
        want |= {(q, i + 1): (d, -s) for i, (s, d) in enumerate(scored)}
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in feedback_queries.fitted_rerank(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] or abs(got[k][1] - want[k][1]) < 2e-6 for k in got)
