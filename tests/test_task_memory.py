"""What the functions of tasks hold, on a batch that is given to them here."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siftwell.operators import chunking, lexical, vectors
from siftwell.operators.vectors import hashed_embedding


@pytest.fixture
def peak(spark, monkeypatch):
    """peak(make, columns): MB that the last Python function of a plan's tasks allocates for a batch, and its rows."""

    def run(make, **columns):
        made, kind = [], type(spark.range(1))
        for how in ("mapInArrow", "mapInPandas"):
            monkeypatch.setattr(kind, how, lambda self, fn, schema, how=how: made.append((how, fn)) or spark.createDataFrame([], schema))
        make()
        monkeypatch.undo()
        how, fn = made[-1]
        batch = pa.RecordBatch.from_pydict(columns)
        tracemalloc.start()
        most, rows = 0, []
        # The bytes of results that were passed on aren't the task's any more.
        for got in fn(iter([batch if how == "mapInArrow" else batch.to_pandas()])):
            most = max(most, tracemalloc.get_traced_memory()[1])
            rows += list(map(tuple, (got.to_pandas() if how == "mapInArrow" else got).itertuples(index=False)))
            tracemalloc.reset_peak()
        tracemalloc.stop()
        return most / 1e6, rows

    return run


def test_semantic_chunks_of_a_long_text_hold_some_sentences(spark, peak):
    """Vectors of all sentences would be ten times the text."""
    text = " ".join(f"Word a{i % 97} b{i % 89}." for i in range(30_000))
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    mb, rows = peak(lambda: chunking.semantic(docs), doc_id=[1], text=[text])
    assert mb < 12, mb
    assert [r[1] for r in rows] == list(range(len(rows))) and " ".join(r[2] for r in rows) == text
    s = text.split(". ")
    s = [x + "." for x in s[:-1]] + s[-1:]
    v = np.stack([hashed_embedding(re.findall(r"\w+", x.lower())) for x in s])
    assert [r[2] for r in rows] == chunking.split_semantic(s, v, 0.3, 50, 300)


@pytest.mark.parametrize("itself", [False, True])
def test_search_holds_some_scores_of_a_pair_of_blocks(spark, peak, itself):
    """A table of all scores of a pair is 8 MB, and a measure makes several. Ties go to the least id; rows that aren't numbers and zeros of no length are as before."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(vectors.BLOCK, 16)), 1)
    v[100:200] = v[:100]
    v[7], v[8, 3] = 0, np.nan
    ids = rng.permutation(vectors.BLOCK).astype("<i8")
    q, qids = v[: vectors.QUERY_BLOCK], ids[: vectors.QUERY_BLOCK]
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    pair = {"vi": [ids.tobytes()], "vv": [v.tobytes()], "qi": [qids.tobytes()], "qv": [q.tobytes()]}
    mb, rows = peak(lambda: vectors.search(df, df, 5, itself=itself), **pair)
    assert mb < 16, mb
    want = []
    for i, x in zip(qids.tolist(), np.round(vectors.METRICS["cosine"](q, v), 6)):
        own = sorted((-s, j) for j, s in zip(ids.tolist(), x.tolist()) if s == s and (itself or i != j))
        want += [(i, j, -s) for s, j in own[:5]]
    assert rows == want


def test_ranked_holds_one_table_of_cells(spark, peak):
    """Counts, their parts and what these are made of were tables of documents and terms."""
    asked = spark.createDataFrame([(q, f"t{q * 20 + i}", 1) for q in range(100) for i in range(20)], "query_id long, token string, qtf long")
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    texts = [" ".join(f"t{(7 * d + i) % 2000} T{d % 2000}" for i in range(10)) for d in range(1000)]
    mb, _ = peak(lambda: lexical.ranked(docs, asked, 5, (lexical.OKAPI, lexical.PLUS)), doc_id=list(range(1000)), text=texts)
    assert mb < 30, mb
