"""Queries without SQL against plain Python."""

import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from datetime import timedelta

import numpy as np
import pytest

from siftwell.functions import privacy as P
from siftwell.functions import text as T
from siftwell.operators import ratelimit
from siftwell.operators.vectors import hashed_embedding
from siftwell.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"\w+")


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def words(text):
    return WORD.findall((text or "").lower())


def test_unicode_forms(spark):
    got = {r.doc_id: r for r in QUERIES["unicode_forms"](spark, SF).collect()}
    for r in rows(spark, "documents"):
        for form in ("NFD", "NFKC", "NFKD"):
            assert got[r.doc_id][form.lower()] == hashlib.md5(unicodedata.normalize(form, r.text or "").encode()).hexdigest()
    one = spark.createDataFrame([("ﬁ é Å",), (None,)], "t string").select(T.normalised("t", "NFKC").alias("t")).collect()
    assert [r.t for r in one] == ["fi é Å", ""]


def test_vectors_in_half_precision_and_their_keys(spark):
    own = {r.vec_id: r.embedding for r in rows(spark, "embeddings")}
    for r in QUERIES["float16_vectors"](spark, SF).collect():
        assert np.array_equal(np.array(r.embedding), np.array(own[r.vec_id], np.float16).astype(np.float32))
        assert r.key == hashlib.md5(json.dumps([round(float(x), 6) for x in own[r.vec_id]]).encode()).hexdigest()


def test_principal_components(spark):
    own = rows(spark, "embeddings")
    x = np.array([r.embedding for r in own], float)
    x -= x.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = {r.vec_id: np.array(r.reduced) for r in QUERIES["pca_vectors"](spark, SF).collect()}
    y = np.array([got[r.vec_id] for r in own])
    # Components have a sign of their own.
    assert np.allclose(np.abs(y), np.abs(u[:, :8] * s[:8]), atol=1e-6)


def test_embeddings_are_made_once_for_each_text(spark):
    docs = rows(spark, "documents")
    got = {r.doc_id: r.embedding for r in QUERIES["embed_once"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        assert np.allclose(got[r.doc_id], hashed_embedding(words(r.text)))


def test_html_text(spark):
    got = {r.page_id: r.text for r in QUERIES["html_text"](spark, SF).collect()}
    for r in rows(spark, "pages"):
        t = re.sub(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ", r.html or "")
        t = re.sub(r"<[^>]*>", " ", t)
        for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            t = t.replace(a, b)
        assert got[r.page_id] == re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")


def test_pii_spans(spark):
    want = set()
    for r in rows(spark, "documents"):
        want |= {(r.doc_id, k, m.start(), m.end(), m[0]) for k, p in P.PERSONAL.items() for m in re.finditer(p, r.text or "")}
    got = [tuple(r) for r in QUERIES["pii_spans"](spark, SF).collect()]
    assert len(got) == len(want) > 0 and set(got) == want


def test_rate_limit_decisions(spark):
    by_user = defaultdict(list)
    for r in rows(spark, "events"):
        by_user["anonymous" if r.user_id is None else str(r.user_id)].append((r.ts, r.event_id))
    want = {}
    for user, events in by_user.items():
        started = {"m": None, "d": None}
        used = {"m": 0, "d": 0}
        for ts, e in sorted(events):
            ok = True
            for k, width, most in (("m", timedelta(minutes=1), 2), ("d", timedelta(days=1), 8)):
                if started[k] is None or ts - started[k] >= width:
                    started[k], used[k] = ts, 0
                if used[k] >= most:
                    ok = False
                    break
                used[k] += 1
            want[user, e] = ok
    got = {(r.user_id, r.event_id): r.admitted for r in QUERIES["rate_limit_decisions"](spark, SF).collect()}
    assert got == want and len(set(got.values())) == 2


@pytest.fixture(scope="module")
def candidates(spark):
    e = {r.vec_id: np.array(r.embedding, float) for r in rows(spark, "embeddings")}
    unit = {i: v / np.linalg.norm(v) for i, v in e.items()}
    out = {}
    for q in sorted(i for i in e if i % 100 == 0):
        near = sorted(((-round(float(unit[q] @ unit[i]), 6), i) for i in e if i != q))[:40]
        out[q] = [(-s, i) for s, i in near]
    return unit, out


def test_mmr(spark, candidates):
    unit, lists = candidates
    want = {}
    for q, own in lists.items():
        kept = [own[0]]
        left = own[1:]
        while left and len(kept) < 10:
            sim = lambda c: max(min(1.0, max(0.0, float(unit[c[1]] @ unit[k[1]]))) for k in kept)  # noqa: E731, B023
            best = max(left, key=lambda c: (0.7 * min(1.0, max(0.0, c[0])) - 0.3 * sim(c)))
            if sim(best) > 0.8:
                break
            kept.append(best)
            left.remove(best)
        want[q] = [i for _, i in kept]
    got = defaultdict(list)
    for r in QUERIES["mmr_select"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == want


def test_semantic_mmr_holds_the_threshold_last(spark):
    near = {(r.query_id, r.vec_id): r.relevance for r in QUERIES["semantic_mmr"](spark, SF).collect()}
    ranks = {(r.query_id, r.vec_id): r.rank for r in QUERIES["semantic_mmr"](spark, SF).collect()}
    chosen = {(r.query_id, r.vec_id): r.rank for r in QUERIES["mmr_select"](spark, SF).collect()}
    assert all(x >= 0.2 for x in near.values())
    # The first ten are those of mmr_select, ranks and all, but for what the threshold drops.
    assert {k: r for k, r in ranks.items() if r <= 10}.items() <= chosen.items()


def test_a_reranker_wants_a_number():
    from siftwell.operators import rerank

    with pytest.raises(ValueError):
        rerank.rerank(None, None, 0)


def test_diversify(spark, candidates):
    unit, lists = candidates
    want = {}
    for q, own in lists.items():
        kept = []
        for _, i in own:
            if all(float(unit[i] @ unit[k]) <= 0.3 for k in kept):
                kept.append(i)
        want[q] = kept
    got = defaultdict(list)
    for r in QUERIES["diversify"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == want


def test_jaccard_context_dedup(spark):
    texts = {r.doc_id: set(words(r.text)) for r in rows(spark, "documents")}
    lists = defaultdict(list)
    from siftwell.operators import fusion, lexical
    from siftwell.plans import retrieval_queries as R

    for r in lexical.top(fusion.rrf(R._lists(spark, SF)), 20).orderBy("query_id", "rank").collect():
        lists[r.query_id].append((r.rank, r.doc_id))
    want = set()
    for q, own in lists.items():
        kept = []
        for rank, d in own:
            near = lambda k: texts[d] and texts[k] and len(texts[d] & texts[k]) >= 0.8 * len(texts[d] | texts[k])  # noqa: E731, B023
            if not any(near(k) for k in kept):
                kept.append(d)
                want.add((q, d, rank))
    got = {tuple(r) for r in QUERIES["jaccard_context_dedup"](spark, SF).collect()}
    assert got == want


def test_limiter_state_can_be_taken_up(spark):
    one = ratelimit.Limiter(2, 8)
    first = [one.admit(t) for t in (0.0, 1.0, 2.0)]
    two = ratelimit.Limiter(2, 8, tuple(map(tuple, one.state)))
    assert first == [True, True, False] and [two.admit(t) for t in (59.0, 60.0)] == [False, True]
