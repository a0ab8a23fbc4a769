import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from siftwell.llm import _kernel as K
from siftwell.llm import language as L
from siftwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_model(rows):
    """{lang: {context: Counter of next bytes}} byte by byte."""
    out = defaultdict(lambda: defaultdict(Counter))
    for text, lang in rows:
        raw = b"\0" * L.ORDER + (text or "").encode()
        for i in range(L.ORDER, len(raw)):
            for k in range(L.ORDER + 1):
                out[lang][raw[i - k : i]][raw[i]] += 1
    return out


def plain_bits(tree, text):
    raw, total = b"\0" * L.ORDER + text.encode(), 0.0
    for i in range(L.ORDER, len(raw)):
        for k in range(L.ORDER, -1, -1):
            of = tree.get(raw[i - k : i])
            if of and raw[i] in of:
                total += math.log2((sum(of.values()) + len(of)) / of[raw[i]])
                break
            if of:
                total += math.log2((sum(of.values()) + len(of)) / len(of))
        else:
            total += 8
    return total


def test_runs_of_bytes():
    texts = ["abcde", "", "x", None, "yz"]
    (s,) = K.slices(pa.array(texts))
    want = []
    for t in texts:
        raw = b"\0\0\0" + (t or "").encode()
        want += [int.from_bytes(raw[i : i + 4], "big") for i in range(len(raw) - 3)]
    assert L.byte_runs(s).tolist() == want


def test_against_plain_python(spark):
    rows = [("der hund läuft und bellt", "de"), ("the dog runs and barks", "en"), ("und der andere", "de"), ("", "fr"), (None, "fr"), ("le chien court", "fr"), ("xyz", None)]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    trees = plain_model([r for r in rows if r[1]])
    asked = ["der hund", "dogs and barking", "le chien", "zzzz", "q", "\0\0\0", "длинный текст"]
    want = [[plain_bits(trees[x], t) for x in sorted(trees)] for t in asked]
    assert [*model.trees] == ["de", "en", "fr"] and np.allclose(model.code_lengths(pa.array(asked)), want)


def test_pruned_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tree = L.fit(docs, nodes=8000).trees["en"]
    assert max(len(x) for x in tree.runs) <= 2000
    for context in (b"th", b"e ", b"zq"):
        runs = np.array([int.from_bytes(b"\0" + context + bytes([x]), "big") for x in range(256)], np.uint64)
        # Escapes also give to bytes that were seen, so a little less than 1 is left in all.
        assert 0.3 < np.exp2(-tree.lengths(runs)).sum() <= 1 + 1e-9


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op13_language"](spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(out) > 200 and np.mean(out) > 0.95


def test_query_against_plain_python(spark):
    """On the smallest table, from trees of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    trees = plain_model([(r.text, r.lang) for r in docs if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1])
    got = {r.doc_id: r for r in QUERIES["op13_language"](spark, "/root/testdata/sf0.001").collect()}
    for r in [d for d in docs if len(d.text or "") < 3000]:
        bits = {x: plain_bits(trees[x], r.text or "") for x in sorted(trees)}
        best = min(bits, key=bits.get)
        if any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == best, r.doc_id
            assert abs(got[r.doc_id].score - 1 / sum(2 ** max(bits[best] - b, -1000) for b in bits.values())) < 1e-6
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "abc", "en", 2.0), (None, None, "en", None), (1, "abc", "en", 2.0), (2, "", None, 1.0), (3, "12 !", "", None)], "doc_id long, text string, lang string, SCORE double")
    model = L.fit(docs)
    out = L.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = [(r.doc_id, r.text, r.lang_pred, r.score) for r in out.collect()]
    assert [r[1:3] for r in rows] == [("abc", "en"), (None, "und"), ("abc", "en"), ("", "und"), ("12 !", "und")] and rows[0][3] > 0.9 and rows[1][3] == 0
    none = L.predict(docs, L.fit(docs.limit(0)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert L.predict(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([("é" * 3_000_000,)], "text string")
    assert L.predict(long, model).head().lang_pred in ("", "en")
