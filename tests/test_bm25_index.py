import math
import re
from collections import Counter

from siftwell.operators import evaluation, lexical

DOCS = [(1, "The red fox and the dog"), (2, None), (3, ""), (4, "fox fox fox"), (5, "a dog, a red dog"), (6, "nothing of it")]
ASKED = [(10, "red fox red"), (11, "the dog"), (12, "unseen")]


def expected(k1=1.2, b=0.75):
    words = {d: re.findall(r"\w+", (t or "").lower()) for d, t in DOCS}
    mean, df = sum(map(len, words.values())) / len(words), Counter(t for w in words.values() for t in set(w))
    out = {}
    for q, text in ASKED:
        for d, w in words.items():
            tf = Counter(w)
            s = [math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / mean)) for t in text.split() if tf[t]]
            if s:
                out[q, d] = round(sum(s), 6)
    return out


def test_scores_are_summed_where_postings_are(spark, monkeypatch):
    """Texts aren't read again once the index is written, and parts of scores aren't shuffled by query; the join of large query sets gives the same."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = lexical.terms(spark.createDataFrame(ASKED, "id long, text string"), "id")
    out = lexical.bm25(docs, asked)
    plan = out._jdf.queryExecution().toString()
    assert "regexp" not in plan and "hashpartitioning(query_id" not in plan
    monkeypatch.setattr(lexical, "QUERY_ROWS", 0)
    for rows in (out, lexical.bm25(docs, asked)):
        assert {(r.query_id, r.doc_id): r.score for r in rows.collect()} == expected()
    assert lexical.bm25(docs.where("false"), asked).count() == 0


def test_texts_are_cut_into_words_once(spark):
    """Neither postings nor shared runs filter by the words before they make them."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame([(10, "a dog A RED dog and more"), (11, "too few"), (12, None)], "query_id long, text string")
    rows, shared = lexical.postings(docs), evaluation.shares_run(docs, asked)
    for df in (rows, shared):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [tuple(r) for r in shared.collect()] == [(10, 5)]
    assert {(r.doc_id, r.token, r.tf, r.dl) for r in rows.collect() if r.doc_id in (2, 3, 4)} == {(4, "fox", 3, 3)}
