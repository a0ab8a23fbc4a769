"""Large query sets are scored by their terms' lists where documents are."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import lexical, pair_scorer
from siftwell.plans import feedback_queries

MODELS = (lexical.OKAPI, lexical.PLUS)


def rows_of(found):
    return sorted(tuple(r[c] for c in ("query_id", "doc_id", "score", "rank")) for r in found.collect())


@pytest.mark.parametrize("dense", [0.0, 0.05, 2.0])
def test_lists_give_what_cells_give_and_join_nothing(spark, monkeypatch, dense):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choices(words, range(40, 0, -1), k=rng.randint(0, 12)))
    rows = [(f"d{i}", text()) for i in range(90)] + [("copy", "w1 w2"), ("copyb", "w1 w2"), (None, "w1"), ("null", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    terms = lexical.terms(spark.createDataFrame([(i, text()) for i in range(9)], "query_id long, text string"), "query_id")
    among = F.col("doc_id") < "d5"
    want = [rows_of(x) for x in lexical.ranked(docs, terms, 4, MODELS)] + [rows_of(lexical.ranked(docs, terms, 4, among=among)[0])]
    assert want[0]
    for name, value in (("QUERY_CELLS", 0), ("QUERY_TERMS", 25), ("CELLS", 120), ("DENSE", dense), ("SLICE", 7)):
        monkeypatch.setattr(lexical, name, value)
    # Postings of all documents are more than their texts, and their joins with a query set grow with the square.
    monkeypatch.setattr(lexical, "bm25", None)
    assert [rows_of(x) for x in lexical.ranked(docs, terms, 4, MODELS)] + [rows_of(lexical.ranked(docs, terms, 4, among=among)[0])] == want
    assert lexical.ranked(docs.limit(0), terms, 4)[0].count() == 0


def test_best_of_a_task_are_cut_as_they_come():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    best, score = lexical._Best(3, 2, pa.string()), rng.integers(0, 4, (60, 3)).astype(float)
    best.room = 5
    for lo in range(0, 60, 7):
        best.add(pa.array([f"{59 - i:02d}" for i in range(lo, min(lo + 7, 60))]), score[lo : lo + 7])
        assert best.held <= 5 + 21
    best.cut()
    got = sorted(zip(best.q.tolist(), best.ids.to_pylist(), best.score.tolist()))
    want = [(q, i, s) for q in range(3) for s, i in sorted((-score[59 - int(i), q], i) for i in (f"{x:02d}" for x in range(60)))[:2]]
    assert got == sorted((q, i, -s) for q, i, s in want)


def test_only_numbers_of_candidates_are_stored(spark, monkeypatch):
    """Candidates' words were a table of several times the documents."""
    seen = {}
    put = feedback_queries.written
    monkeypatch.setattr(feedback_queries, "written", lambda df, name: seen.update({name: dict(df.dtypes)}) or put(df, name))
    feedback_queries._described(spark, "/root/testdata/sf0.001")
    assert seen and not any(kind in ("string", "array<string>") for kinds in seen.values() for kind in kinds.values())


def test_compared_texts_with_runs(spark):
    rows = [("a b c d e", "x A b c d e y"), ("a b c d", "a b c d"), (None, None), ("a b c d e", "b c d e a")]
    got = spark.createDataFrame(rows, "q string, t string").coalesce(1).select(pair_scorer.compared(F.col("q"), F.col("t")).alias("c")).select("c.*").collect()
    assert [(r.words, r.pairs, round(r.jaccard, 6), r.run) for r in got] == [(1, 1, 0.714286, True), (1, 1, 1, False), (0, 0, 1, False), (1, 0.75, 1, False)]


def test_documents_are_not_ordered_once_bars_have_risen(monkeypatch):
    """Scores of every slice were rounded and ordered for each query, also where none of them reaches a bar."""
    import numpy as np
    import pyarrow as pa

    ordered = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **k: ordered.append(len(x)) or partition(x, *a, **k))
    rng = np.random.default_rng(6)
    score = np.concatenate([10 + rng.random((40, 5)), rng.random((400, 5))])
    score[100, 2] = score[:40, 2].max() + 1
    score[200, 3] = np.sort(np.round(score[:40, 3], 6))[-4] - 4e-7  # reaches the bar as it is rounded
    best = lexical._Best(5, 4, pa.int64())
    for lo in range(0, 440, 40):
        best.add(pa.array(range(lo, lo + 40)), score[lo : lo + 40])
    best.cut()
    assert ordered == [40]
    own = np.round(score, 6)
    want = [(q, d, own[d, q]) for q in range(5) for d in np.lexsort((np.arange(440), -own[:, q]))[:4].tolist()]
    assert list(zip(best.q.tolist(), best.ids.to_pylist(), best.score.tolist())) == want


def test_runs_are_made_of_shared_pairs_only():
    """All runs of both texts were made for each pair."""
    rng = random.Random(9)
    shared = 0
    for _ in range(400):
        w, d = ([rng.choice("ab") for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = set(zip(w, w[1:])) & set(zip(d, d[1:]))
        want = bool({tuple(w[i : i + 5]) for i in range(len(w) - 4)} & {tuple(d[i : i + 5]) for i in range(len(d) - 4)})
        assert pair_scorer._share_run(w, d, pairs) == want
        shared += want
    assert 20 < shared < 380
    known = pair_scorer._Texts()
    assert len(known("one two three four five six")) == 3
