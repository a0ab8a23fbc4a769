import random

import pytest

from siftwell.operators import lexical, lexical_index
from siftwell.operators.lexical_index import LexicalIndex, Report

SCHEMA = "doc_id long, text string"


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def corpus(n, seed, start=0):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    return {start + i: " ".join(rng.choices(words[: rng.choice([30, 400])], k=rng.choice([3, 12, 80]))) for i in range(n)}


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 8)


def test_equal_to_ranking_the_live_documents_after_every_change(spark, tmp_path, small):
    index, live, queries = LexicalIndex(spark, str(tmp_path)), {}, corpus(12, 99)
    terms = lexical.terms(spark.createDataFrame([*queries.items(), (50, "w1 w1 w3 nothing"), (51, "")], SCHEMA), "doc_id")
    frame = lambda d: spark.createDataFrame(list(d.items()), SCHEMA)

    def same():
        want = rows_of(lexical.ranked(frame(live), terms, 5)[0]) if live else []
        assert rows_of(index.search(terms, 5)) == want

    same()
    for change in (corpus(150, 1), corpus(90, 2, 150)):
        index.insert(frame(change))
        live |= change
        same()
    gone = [*range(0, 60, 2), 200, 9999]
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    live = {i: t for i, t in live.items() if i not in gone}
    same()
    other = corpus(40, 3, 20)
    index.upsert(frame(other))
    live |= other
    same()
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    live = {i: t for i, t in live.items() if i not in gone}
    assert index.merge() == index.versions.latest()
    assert [r.kind for r in index.versions.read().collect()] == ["segment"]
    same()


def test_odd_rows_and_ties(spark, tmp_path, small):
    rows = [(i, "same words here") for i in range(40)] + [(None, "same words here"), (41, None), (42, ""), (7, "same words here")]
    df = spark.createDataFrame(rows, SCHEMA)
    terms = lexical.terms(spark.createDataFrame([(1, "words"), (2, "none such")], SCHEMA), "doc_id")
    index = LexicalIndex(spark, str(tmp_path))
    index.insert(df)
    assert rows_of(index.search(terms, 6)) == rows_of(lexical.ranked(df, terms, 6)[0])
    index.delete(df.select("doc_id"))
    assert [r for r in rows_of(index.search(terms, 6))] == []


def test_blocks_are_skipped(spark, tmp_path, small):
    docs = {i: " ".join(["common"] * (1 + i % 40)) + (" rare" if i in (5, 300) else "") for i in range(400)}
    index, report = LexicalIndex(spark, str(tmp_path)), Report()
    index.insert(spark.createDataFrame(list(docs.items()), SCHEMA))
    terms = lexical.terms(spark.createDataFrame([(1, "rare common"), (2, "rare")], SCHEMA), "doc_id")
    found = index.search(terms, 2, report=report)
    assert rows_of(found) == rows_of(lexical.ranked(spark.createDataFrame(list(docs.items()), SCHEMA), terms, 2)[0])
    assert 0 < report.read < report.blocks / 2


def test_what_a_crash_leaves_does_not_count(spark, tmp_path, small, monkeypatch):
    index = LexicalIndex(spark, str(tmp_path))
    index.insert(spark.createDataFrame([(1, "a b")], SCHEMA))
    terms = lexical.terms(spark.createDataFrame([(1, "a")], SCHEMA), "doc_id")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(LexicalIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError()))
        index.insert(spark.createDataFrame([(2, "a a")], SCHEMA))
    assert [r[2] for r in rows_of(LexicalIndex(spark, str(tmp_path)).search(terms, 5))] == [1]


def test_batches_of_queries(spark, tmp_path, small, monkeypatch):
    docs, queries = corpus(60, 5), corpus(9, 6)
    df, terms = spark.createDataFrame(list(docs.items()), SCHEMA), lexical.terms(spark.createDataFrame(list(queries.items()), SCHEMA), "doc_id")
    want, zeros = rows_of(lexical.ranked(df, terms, 4)[0]), rows_of(lexical.ranked(df, terms, 70, zeros=True)[0])
    index = LexicalIndex(spark, str(tmp_path))
    index.insert(df)
    monkeypatch.setattr(lexical_index, "QUERY_CELLS", 300)
    monkeypatch.setattr(lexical, "QUERY_CELLS", 300)
    assert rows_of(index.search(terms, 4)) == want
    assert rows_of(lexical.ranked(df, terms, 70, zeros=True)[0]) == zeros
