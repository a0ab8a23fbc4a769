import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from siftwell.llm import _kernel as K
from siftwell.llm import quality as Q
from siftwell.llm._labels import held_out
from siftwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_pairwise_identity():
    rng = np.random.default_rng(3)
    m = Q.train(np.zeros((0, Q.BUCKETS), np.float32), np.zeros((0, len(Q.STATS))), np.zeros(0))
    d = Q.BUCKETS + len(Q.STATS)
    m.factors, m.linear, m.bias = rng.normal(0, 0.1, (d, 3)), rng.normal(0, 0.1, d), 0.3
    x = np.zeros((4, d))
    x[:, rng.integers(0, d, 12)] = rng.normal(0, 1, (4, 12))
    pairs = [sum(m.factors[i] @ m.factors[j] * r[i] * r[j] for i in np.flatnonzero(r) for j in np.flatnonzero(r) if i < j) for r in x]
    assert np.allclose(m.margin(x), 0.3 + x @ m.linear + pairs)


def test_features_do_not_depend_on_neighbours():
    texts = ["a b a\nb", "", "É| x x### 9", None, "word " * 3000]
    together = Q.features(pa.array(texts))
    for i, t in enumerate(texts):
        alone = Q.features(pa.array([t], pa.string()))
        assert np.array_equal(alone[0][0], together[0][i]) and np.allclose(alone[1][0], together[1][i])
    assert not together[1][1].any() and not together[1][3].any()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = Q.fit(docs, labels)
    rows = Q.score(docs, m).join(labels, "doc_id").select("doc_id", "score", "quality", held_out(0, 5).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.out]
    assert len(out) > 50 and np.mean([(r.score >= 0.3) == r.quality for r in out]) > 0.95


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (None, None, "x"), (1, "a", "x"), (2, "", None)], "doc_id long, text string, SCORE string")
    none = spark.createDataFrame([(None, None), (3, None)], "doc_id long, quality int")
    out = Q.score(docs, Q.fit(docs, none))
    assert out.columns == ["doc_id", "text", "score"] and [r.score for r in out.collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.score(docs, Q.fit(docs, one)).collect())
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), one)).count() == 0


def plain_features(text):
    """Counts by bucket and statistics of one text, counted word by word."""
    raw = (text or "").encode()
    lower = bytes(K.lower_bytes(np.frombuffer(raw, np.uint8)))
    words, folded = (re.findall(rb"[^\x20\x09-\x0d]+", x) for x in (raw, lower))
    counts = np.zeros(Q.BUCKETS)
    for w in folded:
        counts[int(K.span_hash(K.lanes(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0]) >> 54] += 1
    if not raw:
        return counts, np.zeros(len(Q.STATS))
    n, k = len(raw), max(len(words), 1)
    among = lambda chars: sum(b in chars for b in raw) / n
    symbols = set(b"#$%&*+<=>@[\\]^_`{|}~")
    lines = [x for x in raw.split(b"\n") if x]
    stats = [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / k, among(b"|"), among(symbols), among(b"0123456789"), among(bytes(range(65, 91))), among(b"."), among(b"\n"),
        sum(b > 127 for b in raw) / n, len(set(folded)) / k, sum(a == b for a, b in zip(folded, folded[1:])) / k, sum(w[-1] in symbols for w in words) / k,
        len(set(lines)) / max(len(lines), 1), max(Counter(folded).values(), default=0) / k, sum(len(w) > 24 for w in words) / k, 1 / (1 + len(words)),
    ]
    return counts, np.array(stats)


def test_query_against_plain_python(spark):
    """The score of each document from its own features, with every pair of features as a term of its own."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = Q.fit(docs, labels, metadata=("n_chars",))
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        counts, stats = plain_features(r.text)
        meta = [np.log1p(abs(r.n_chars)) * np.sign(r.n_chars), 0.0] if r.n_chars is not None else [0.0, 1.0]
        x = np.log1p(counts) / max(np.sqrt((np.log1p(counts) ** 2).sum()), 1e-6)
        z = np.clip((np.concatenate([stats, meta]) - m.mean) / m.scale, -5, 5) / 2
        x = np.concatenate([x, z])
        at = np.flatnonzero(x)
        v = m.factors[at].astype(float) * x[at, None]
        pairs = (v @ v.T)[np.triu_indices(len(at), 1)].sum()
        want = 1 / (1 + np.exp(-np.clip(m.bias + x @ m.linear + pairs, -30, 30)))
        one = got[r.doc_id]
        assert abs(one.score - want) < 2e-3, r.doc_id
        assert one.predicted == int(one.score >= 0.3) and one.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_metadata_and_large_counts(spark):
    x = Q.metadata_features([pa.array([1, None, -3]), pa.array([float("nan"), 2.5, float("inf")])])
    assert np.allclose(x, [[np.log(2), 0, 0, 1], [0, 1, np.log(3.5), 0], [-np.log(4), 0, 0, 1]])
    docs = spark.createDataFrame([(i, ("many " * 70_000 if i == 0 else f"a{i} b"), None if i == 3 else i) for i in range(8)], "doc_id long, text string, size long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    m = Q.fit(docs, labels, fold=9, metadata=("size",))
    assert m.metadata == ("size",) and len(m.mean) == len(Q.STATS) + 2
    out = Q.score(docs, m)
    assert out.columns == ["doc_id", "text", "size", "score"] and all(0 <= r.score <= 1 for r in out.collect())
    counts, _ = Q.features(pa.array(["many " * 70_000]))
    assert counts.max() == 70_000
