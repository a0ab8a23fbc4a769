"""Chunkers against what their descriptions say, and the queries that have no SQL against these."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.operators import chunking as C
from siftwell.operators.vectors import hashed_embedding
from siftwell.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
TEXT = st.lists(st.sampled_from(["a", "bb", "é", " ", "  ", "\n", "\n\n", ". ", ".", "\t"]), max_size=40).map("".join)


def squeezed(text):
    return "".join(text.split())


def test_recursive_by_hand():
    cut = lambda t, size, overlap=0, **o: C.split_recursive(t, size, overlap, **o)
    assert cut("a b c", 3) == ["a b c"] and cut(" \n", 3) == [] and cut("", 3) == []
    assert cut("a b\n\nc d\n\ne", 4) == ["a b\n\nc d", "\n\ne"]
    # The second paragraph is too long: what stands before it is closed, its lines are packed, and the rest starts anew.
    assert cut("a\n\nb c\nd e\nf\n\ng", 3) == ["a", "\nb c", "\nd e\nf", "\n\ng"]
    assert cut("a b c d e", 2) == ["a b", " c d", " e"]
    assert cut("a b c d e", 2, keep=False) == ["a b", "c d", "e"]
    # Two words are carried on where the piece before has more; " d" finds no room for them.
    assert cut("a b c d e f", 3, 2) == ["a b c", "b c d", "c d e", "d e f"]
    assert cut("a b c d", 2, 2) == ["a b", " c d"]
    assert cut("One two. Three. Four five six", 3) == ["One two", ". Three", ". Four five six"[:10], " six"] or cut("One two. Three. Four five six", 4) == ["One two. Three", ". Four five six"]
    assert cut("a\tb\tc", 2, separators=["\n"]) == ["a\tb\tc"]


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 6), st.integers(0, 3))
def test_recursive_keeps_words_in_order(text, size, overlap):
    pieces = C.split_recursive(text, size, 0, ["\n\n", "\n", " ", ""])
    assert squeezed("".join(pieces)) == squeezed(text)
    assert all(len(p.split()) <= size for p in pieces) and all(p.strip() for p in pieces)
    more = C.split_recursive(text, size, overlap, ["\n\n", "\n", " ", ""])
    assert set(squeezed("".join(more))) == set(squeezed(text))
    # Neighbours on one level could not have been one piece, unless a cut of a higher level stands between them.
    for a, b in zip(pieces, pieces[1:]):
        assert len(a.split()) + len(b.split()) > size or "\n" in text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0)])), max_size=12), st.integers(0, 12), st.integers(1, 25), st.booleans())
def test_semantic_cuts_where_it_must(parts, least, most, embedded):
    sentences = [" ".join(["w"] * n) + f"{i}" for i, (n, _) in enumerate(parts)]
    vectors = np.array([v for _, v in parts]).reshape(-1, 2) if embedded else None
    out = C.split_semantic(sentences, vectors, 0.3, least, most)
    assert " ".join(out) == " ".join(sentences)
    at = 0
    for chunk in out:
        n = 0
        while " ".join(sentences[at : at + n]) != chunk:
            n += 1
        # Every sentence of the chunk but its last was no place to cut, and the last one is, or is the end.
        for i in range(at, at + n):
            words = sum(len(s.split()) for s in sentences[at : i + 1])
            unlike = embedded and i + 1 < len(sentences) and vectors[i] @ vectors[i + 1] < 0.3
            must = words >= most or (unlike and words >= least)
            assert must == (i == at + n - 1) or i + 1 == len(sentences)
        at += n
    assert at == len(sentences)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_queries_of_chunks(spark):
    docs = texts(spark)
    got = {(r.doc_id, r.chunk_index): r.content for r in QUERIES["chunk_recursive"](spark, SF).collect()}
    want = {(d, i): c.strip() for d, t in docs.items() for i, c in enumerate(C.split_recursive(t, 128, 16)) if c.strip()}
    assert got == want and len(got) > len(docs)
    got = {(r.doc_id, r.chunk_index): r.content for r in QUERIES["chunk_semantic"](spark, SF).collect()}
    want = {}
    for d, t in docs.items():
        s = [x.strip() for x in re.split(r"(?<=[.!?])\s+", t) if x.strip()]
        v = np.array([hashed_embedding(re.findall(r"\w+", x.lower())) for x in s]).reshape(len(s), 64)
        want |= {(d, i): c for i, c in enumerate(C.split_semantic(s, v, 0.3, 50, 300))}
    assert got == want


def test_windows_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, " ".join(map(str, range(100_000)))), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = C.fixed(df, 50_000, 10_000).collect()
    assert sorted((r.doc_id or 0, r.chunk_index, r.start_token, r.end_token) for r in got) == [(0, 0, 0, 2), (3, 0, 0, 1), (4, 0, 0, 50_000), (4, 1, 40_000, 90_000), (4, 2, 80_000, 100_000)]
    assert [r.content for r in C.sliding(spark.createDataFrame([(1, "A b. C! D? E.")], "doc_id long, text string"), 1, 2).orderBy("chunk_index").collect()] == ["A b. C!", "C! D? E."]
    names = {r.content: r.parent_id for r in C.parent_child(spark.createDataFrame([(7, "a b c d e")], "doc_id long, text string"), (3, 0), (2, 0)).collect()}
    assert set(names) == {"a b", "c", "d e"} and names["a b"] == names["c"] != names["d e"]


def test_strategies_by_name(spark):
    docs = texts(spark)
    got = {(r.doc_id, r.chunk_index): r.content for r in QUERIES["chunk_paragraphs"](spark, SF).collect()}
    assert got == {(d, i): c.strip() for d, t in docs.items() for i, c in enumerate(C.split_recursive(t, 64, 8, ["\n\n", "\n"])) if c.strip()}
    df = spark.createDataFrame([(1, "a\n# H\nb\n\n## \n#x"), (2, "# T"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, C.chunk(df, "markdown_header").collect())) == [(1, 0, "a"), (1, 1, "# H\nb"), (1, 2, "## \n#x"), (2, 1, "# T")]
    assert C.chunk(df, "semantic").count() == 2 and C.chunk(df, "fixed_size", size=2, overlap=0).count() == 4
    with pytest.raises(ValueError):
        C.chunk(df, "unheard of")
