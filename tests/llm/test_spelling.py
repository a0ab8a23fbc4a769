import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import spelling as S
from siftwell.llm.queries import QUERIES


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """{word: (n, n_near, form, form_n, root)} by comparing all words with all."""
    out, forms = {}, {}
    for w, n in counts.items():
        alike = [v for v in counts if near(w, v)]
        best = min(alike, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * n:
            forms[w] = best
        out[w] = (n, len(alike), forms.get(w), counts[forms[w]] if w in forms else None)
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w] += (root,)
    return out


def got(spark, counts, hot):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in S.variants(df, hot=hot).collect()}


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_against_all_pairs(spark, hot):
    rng = np.random.default_rng(hot)
    counts = {}
    for k in range(40):
        w = "".join(rng.choice(list("abé"), rng.integers(7, 13)))
        for _ in range(8):
            i, n = rng.integers(0, len(w)), int(10 ** rng.integers(0, 5)) * int(rng.integers(2, 9))
            counts[w] = n
            w = [w[:i] + w[i + 1 :] if len(w) > 7 else w, w[:i] + "ü" + w[i:], w[:i] + "b" + w[i + 1 :]][rng.integers(0, 3)]
    want = plain(counts)
    assert sum(x[1] for x in want.values()) > 300 and any(want[w][4] != want[w][2] for w in want if want[w][2])
    assert got(spark, counts, hot) == want


def test_long_words_and_repeated_letters(spark):
    counts = {"a" * 5000: 9, "a" * 5001: 900, "a" * 7: 2, "a" * 8: 2, "b" * 9: 5, "a" * 4 + "b" + "a" * 3: 200}
    assert got(spark, counts, 1) == plain(counts)
    assert got(spark, {"abcdefg": 2}, 1) == {"abcdefg": (2, 0, None, None, "abcdefg")}


def test_chain_of_forms(spark):
    counts = {"abcdefg" + "x" * i: 2 * 10**i for i in range(9)}
    assert {v[4] for v in got(spark, counts, 128).values()} == {"abcdefg" + "x" * 8}


def test_runs(spark):
    df = spark.createDataFrame([(1, "ÀBCDEFGH short abcdefg1hijklmnop"), (None, None), (2, ""), (None, "Straßenbahn×÷")], "id long, text string")
    assert sorted(r.run for r in S.runs(df, ["id"]).collect()) == sorted(["straßenbahn×÷", "hijklmnop", "abcdefg", "Àbcdefgh"])
    assert S.variants(S.count(S.runs(df, ["id"]).limit(0).withColumnRenamed("run", "word"))).count() == 0


def test_query_on_odd_documents(spark, tmp_path):
    """Null ids and texts, repeated rows, a word of which the deleted letter leaves too little, and columns that clash with new ones."""
    rng = np.random.default_rng(2)
    letters = list("aàbÉZ")
    words = ["".join(rng.choice(letters, rng.integers(6, 10))) for _ in range(60)]
    rows = [(int(i) if i % 7 else None, " ".join(rng.choice(words, 40)) if i % 9 else None, "x") for i in range(300)]
    spark.createDataFrame(rows + rows[:20], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t, _ in rows + rows[:20]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()}
    assert out == want and any(x[2] for x in want.values())
