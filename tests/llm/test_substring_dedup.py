import random
import re

import numpy as np
import pytest

from siftwell.llm import substring_dedup as S


def slow(texts, window):
    seqs = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(seqs):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in seqs]
    for where in seen.values():
        if len(where) > 1:
            for d, i in where:
                gone[d].update(range(i, i + window))
    return [(" ".join(x for i, x in enumerate(w) if i not in g), len(w), len(g)) for w, g in zip(seqs, gone)]


@pytest.mark.parametrize("seed,window,group", [(1, 35, 100_000), (2, 35, 100_000), (3, 12, 100_000), (4, 35, 4), (5, 12, 1)])
def test_against_brute_force(spark, seed, window, group, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 3000)
    monkeypatch.setattr(S, "GROUP_SLICES", group)
    rnd = random.Random(seed)
    make = lambda n, v=400: [f"w{rnd.randint(0, v)}" for _ in range(n)]
    passages = [make(rnd.randint(30, 120)) for _ in range(6)] + [["ab"] * 90, ["x", "y"] * 45, ["p", "q", "r"] * 20, make(80, 3)]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += make(rnd.randint(0, 60))
            if rnd.random() < 0.6:
                q = list(rnd.choice(passages))
                for _ in range(rnd.randint(0, 2)):
                    q[rnd.randrange(len(q))] = rnd.choice(["changed", "é"])
                a = rnd.randint(0, 20)
                w += q[a : len(q) - rnd.randint(0, 20)]
        texts.append(rnd.choice([" ", "  ", "\n", "\t "]).join(w))
    texts += [None, "", " \n", texts[3], texts[3], texts[5] + " tail", "\x1c a\xa0b", "run " * 34, "run " * 36]
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in enumerate(texts)], "doc_id long, text string, slice string, N_WORDS int").repartition(3)
    out = {r.doc_id: r for r in S.dedup(df, window=window).collect()}
    want = slow(texts, window)
    assert len(out) == len(texts) and sum(x[2] for x in want) > 500
    for i, (kept, n, removed) in enumerate(want):
        assert (out[i].text or "", out[i].n_words, out[i].n_removed) == (kept, n, removed), i
    assert out[len(texts) - 9].text is None


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup(df).count() == 0
    long = " ".join(f"v{i}" for i in range(120_000))
    r = S.dedup(spark.createDataFrame([(1, long), (2, "a b")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].n_removed == 0 and r[0].text == long and r[1].n_words == 2


def test_names_of_regular_sequences_of_words():
    """Of any number of words, equal for equal words only, also where a polynomial would mix them up."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    text = " ".join("ab"[b] for b in bits) + " " + " ".join("ba"[b] for b in bits) + " " + " ".join("ab"[b] for b in bits)
    raw = np.frombuffer(text.encode(), np.uint8)
    p, _ = S.parse(S.K.Slice(0, 1, raw, np.array([0, len(raw)])), [0, 1])
    for n in (1, 2, 35, 64, 100, 1024, 2047, 2048):
        a, b, c = p.names(np.array([0, 2048, 4096]), np.array([0, 2048, 4096]) + n)
        assert a == c != b


def test_equal_substrings_get_equal_symbols_inside(spark):
    rnd = random.Random(2)
    make = lambda n: [f"w{rnd.randint(0, 60)}" for _ in range(n)]
    passage = make(80)
    texts = [" ".join(make(17) + passage + make(9)), " ".join(make(40) + passage), " ".join(passage)]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    slices = S.written(S._slices(spark.createDataFrame([(t,) for t in texts], "text string"), "text"), "slices")
    divisions = S.choose_divisions(slices)
    assert len(divisions) == S.ROUNDS and all(0 <= d < S.DIVISIONS for d in divisions)
    found = []
    for r, at in zip(raw, (17, 40, 0)):
        w, h = S._words(S.K.Slice(0, 1, r, np.array([0, len(r)])))
        symbols = S._Symbols(h, w.first)
        for i, d in enumerate(divisions):
            symbols.runs()
            symbols.pairs(i, d)
        inside = (symbols.lo >= at) & (symbols.hi <= at + 80)
        found.append(list(zip(symbols.ids[inside].tolist(), (symbols.lo[inside] - at).tolist(), (symbols.hi[inside] - at).tolist())))
    assert len(found[0]) > 20 and found[0] == found[1]
    assert set(found[2]) <= set(found[0]) and len(found[2]) > 20
