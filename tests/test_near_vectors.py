import numpy as np
import pytest

from siftwell.operators import vectors
from siftwell.plans.catalogue import QUERIES


def brute(ids, e, least):
    """The least id that chains of pairs reach, of each vector with a link."""
    n = np.linalg.norm(e, axis=1)
    s = np.round((e @ e.T) / np.maximum(n[:, None] * n[None, :], 1e-300), 6) >= least
    np.fill_diagonal(s, False)
    name = ids.copy()
    while True:
        new = np.minimum(name, np.where(s, name[None, :], name.max()).min(axis=1))
        if (new == name).all():
            return {(int(i), int(c)) for i, c, any_ in zip(ids, name, s.any(axis=1)) if any_}
        name = new


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_classes_of_tables(spark, sf):
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    want = brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float), 0.5)
    assert {tuple(r) for r in QUERIES["near_dup_cosine_classes"](spark, f"/root/testdata/{sf}").collect()} == want


def test_classes_without_ids_divisible_by_100_and_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(60, 8))
    e[5], e[25:35], e[40] = e[50] * 2, e[7] + 0.01 * rng.normal(size=(10, 8)), 0
    ids = rng.permutation(99)[:60] + 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, e)] + [(None, [1.0] * 8), (500, None)], "vec_id long, embedding array<double>").repartition(3)
    want = brute(ids, e, 0.9)
    assert want and {tuple(r)[:2] for r in vectors.alike_classes(df, 0.9, rows=7, columns=11).collect()} == want
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    assert {tuple(r)[:2] for r in vectors.alike_classes(df, 0.9, rows=7, columns=11).collect()} == want
    assert vectors.alike_classes(df.limit(0), 0.9).count() == 0


def test_rings_spare_comparisons_and_lose_no_link(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(30, 12))
    e = middles[rng.integers(0, 30, 900)] + 0.12 * rng.normal(size=(900, 12))
    e[100:160] = e[100]  # a group of copies
    e[160:170] = 0
    e[170] = 3 * e[100]
    ids = rng.permutation(5000)[:900]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, e)] + [(int(ids[0]), e[0].tolist())], "vec_id long, embedding array<double>").repartition(3)
    n = np.linalg.norm(e, axis=1)
    s = np.round((e @ e.T) / np.maximum(n[:, None] * n[None, :], 1e-300), 6) >= 0.97
    report = {}
    got = vectors.alike_classes(df, 0.97, rows=20, report=report).collect()
    twice = np.ones(900)
    twice[0] = 2  # the repeated row
    links = {int(i): int(r @ twice - r[j]) for j, (i, r) in enumerate(zip(ids, s)) if r @ twice - r[j] > 0}
    assert {r.vec_id: r.n_links for r in got} == links
    np.fill_diagonal(s, False)
    assert {(r.vec_id, r.class_id) for r in got} >= brute(ids, e, 0.97)
    assert report["compared"] < report["pairs"] / 4
