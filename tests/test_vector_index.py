import numpy as np
import pytest

from siftwell.operators import vector_index, vectors
from siftwell.plans.catalogue import QUERIES


def recall(got, want):
    own = {(r.query_id, r.vec_id) for r in got}
    return sum((r.query_id, r.vec_id) in own for r in want) / max(len(want), 1)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    at = f"/root/testdata/{sf}"
    got, want = (QUERIES[n](spark, at).collect() for n in ("vector_index_topk", "vector_cosine_topk"))
    score = {(r.query_id, r.vec_id): r.score for r in want}
    assert len(got) == len(want) and recall(got, want) >= 0.9
    assert all(abs(r.score - score.get((r.query_id, r.vec_id), r.score)) < 2e-6 for r in got)


def test_clustered_vectors_need_few_probes(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)  # a large cell is many blocks
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16))
    x = middles[rng.integers(0, 40, 3000) * (rng.random(3000) > 0.3)] + 0.05 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id < 30")
    index = vector_index.build(df)
    assert index.cells.count() == 3000 and index.fit_probes(0.95) < len(index.centres) / 2
    want = vectors.search(df, asked, 5).collect()
    assert recall(index.search(asked, 5).collect(), want) >= 0.9
    whole = index.search(asked, 5, probes=len(index.centres)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, want))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (4, None), (5, [2.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build(df)
    asked = df.where("vec_id = 1")
    got, want = (sorted((r["rank"], r.vec_id, r.score) for r in x.collect()) for x in (index.search(asked, 3, probes=99), vectors.search(df, asked, 3)))
    assert got == want and [r[1:] for r in got] == [(5, 1.0), (5, 1.0), (2, 0.0)]
    none = vector_index.build(df.limit(0))
    assert none.search(df, 3).count() == 0 and index.search(df.limit(0), 3).count() == 0
