import math
import re
from collections import Counter

import __spark_entry__ as entry
from siftwell.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"\w+")


def rows(spark, name):
    return [(r[0], r.text or "") for r in spark.read.parquet(f"{SF}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]


def ranked(docs, queries, k1, b, delta, k):
    tf = {i: Counter(WORD.findall(t.lower())) for i, t in docs}
    n, mean, df = len(docs), sum(c.total() for c in tf.values()) / len(docs), Counter(w for c in tf.values() for w in c)
    out = {}
    for q, text in queries:
        scores = {}
        for i, c in tf.items():
            words = [w for w in WORD.findall(text.lower()) if w in c]
            part = [(w, c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * c.total() / mean))) for w in words]
            if part:
                scores[i] = sum(math.log((n + 1) / df[w]) * (delta + x) if delta else math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x for w, x in part)
        out[q] = sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:k], scores
    return out


def test_rankings_of_whole_queries(spark):
    docs, queries = rows(spark, "documents"), rows(spark, "benchmark")
    assert max(len(WORD.findall(t)) for _, t in queries) > 16
    for name, how in (("bm25_topk", (1.2, 0.75, 0.0)), ("bm25_plus_topk", (1.5, 0.75, 0.5))):
        want = ranked(docs, queries, *how, 10)
        got = sorted(QUERIES[name](spark, SF).collect(), key=lambda r: (r.query_id, r.rank))
        assert len(got) == sum(len(ids) for ids, _ in want.values())
        for r in got:
            best, scores = want[r.query_id]
            assert abs(scores[r.doc_id] - r.score) < 2e-6 and abs(scores[best[r.rank - 1]] - r.score) < 2e-6


def test_entry_ranks_by_whole_queries(spark):
    docs, queries = rows(spark, "documents"), rows(spark, "benchmark")
    a, b = ranked(docs, queries, 1.2, 0.75, 0.0, 20), ranked(docs, queries, 1.5, 0.75, 0.5, 20)
    for r in entry.entry(spark).collect():
        want = sum(1 / (61 + x[r.query_id][0].index(r.doc_id)) for x in (a, b) if r.doc_id in x[r.query_id][0])
        assert abs(want - r.score) < 2e-6


def test_counts_of_all_grams(spark):
    want = Counter()
    for _, t in rows(spark, "documents"):
        w = WORD.findall(t.lower())
        want.update(w)
        want.update(f"{x} {y}" for x, y in zip(w, w[1:]))
    assert {r.gram: r.n for r in QUERIES["tokenize_ngrams"](spark, SF).collect()} == want


def test_large_query_sets_and_vectors_are_joined(spark, monkeypatch):
    """Beyond their bounds query sets meet an index and blocks meet by number, with the same results."""
    from siftwell.operators import lexical, vectors

    names = ["bm25_topk", "bm25_plus_topk", "bm25_prefilter", "vector_cosine_topk"]
    of = lambda: {n: sorted(tuple(r[c] for c in sorted(r.asDict())) for r in QUERIES[n](spark, SF).collect()) for n in names}
    small = of()
    monkeypatch.setattr(lexical, "QUERY_CELLS", 0)
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    assert of() == small
