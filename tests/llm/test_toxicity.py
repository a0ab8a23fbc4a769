import itertools
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import _kernel as K
from siftwell.llm import toxicity as T
from siftwell.llm._labels import held_out, sample
from siftwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, T.fit(docs, labels)


def test_grams_against_brute_force(spark):
    texts = ["Ab a", None, "", "é-b", "ab", "É我\U0001f600z", "x" * 3]
    counts = T.count_trigrams(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = Counter()
    for t in texts:
        c = [0, 0, *(T.symbol(x) for x in (t or "").lower()), 0, 0]
        for i in range(2, len(c)):
            want.update([tuple(c[i - k : i + 1]) for k in range(3)])
    model = T.Costs(counts)
    assert counts.sum() == sum(want.values()) and all(model.n(*g) == n for g, n in want.items())
    one = lambda c: (want[(c,)] + 1) / (model.total + model.distinct + 1)
    two = lambda b, c: (want[(b, c)] + 20 * one(c)) / (want[(b,)] + 20)
    for a, b, c in ((1, 2, 0), (0, ord("é"), ord("我")), (5, 6, 7)):
        assert abs(model[a][b][c] + np.log((want[(a, b, c)] + 20 * two(b, c)) / (want[(a, b)] + 20))) < 1e-9


def test_viterbi_finds_the_cheapest_path():
    rng = np.random.default_rng(1)
    cost = rng.uniform(0.2, 5, (27,) * 3)
    decode = T.Decoder(cost)

    def price(choice):
        a = b = 0
        total = 0.0
        for extra, symbol in choice:
            total += extra
            if symbol is not None:
                total += cost[a][b][symbol]
                a, b = b, symbol
        return total + cost[a][b][0]

    for span in ("1d0t", "a|b1", "z9$a"):
        options = []
        for c in span:
            if c.isalpha():
                options.append([(0.0, ord(c) - 96)])
            else:
                options.append([(T.AS_LETTER, ord(x) - 96) for x in T.DISGUISES[c]] + [(T.AS_ITSELF, 0)])
        best = min(itertools.product(*options), key=price)
        word = "".join(c if s == 0 else chr(s + 96) for c, (_, s) in zip(span, best))
        assert decode(span) == word


def test_suspects():
    texts = pa.array(["plain 12 text", "an 1d10t s t u p i d", "sooo", "", "x y", None, "a.b.c"])
    found = [(s.lo + d, span, spaced) for s in K.slices(texts) for d, span, spaced in T.suspects(s, K.lower_bytes(s.data))]
    assert found == [(1, "1d10t", False), (2, "sooo", False), (1, "s t u p i d", True), (6, "a.b.c", True)]


def test_held_out_accuracy_and_disguises(spark, fitted):
    docs, labels, m = fitted
    rows = T.score(docs, m).join(labels, "doc_id").select("doc_id", "score", "toxic", "quality", held_out(2, 4).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    # where quality is 0 here, the text of a toxic document was replaced by junk
    good = [(r.score >= 0.3) == r.toxic for r in rows if r.out and r.quality]
    assert len(good) > 50 and np.mean(good) > 0.95
    told = {r.text: r.score for r in T.score(spark.createDataFrame([("the and idiot the",), ("the and 1d10t the",), ("the and i d i o t the",), ("the and the",)], "text string"), m).collect()}
    assert told["the and the"] < 0.3 <= told["the and idiot the"] and told["the and 1d10t the"] >= 0.3 and told["the and i d i o t the"] >= 0.3
    assert T.restore(spark.createDataFrame([("AN idiiiot",), (None,)], "text string"), m).collect()[1].restored is None


def test_restore_replaces_the_span_and_nothing_else(spark, fitted):
    """A span that also stands inside other words, spans with letters of several bytes around, and repeated spans."""
    m = fitted[2]
    texts = ["hi d it, so: i d i.", "é hi d iö x ü i d i é", "1d10t ok 1d10t", "plain"]
    got = [r.restored for r in T.restore(spark.createDataFrame([(t,) for t in texts], "text string"), m).collect()]
    word, twice = T.Decoder(m.cost)("i d i"), T.Decoder(m.cost)("1d10t")
    assert got[0] == f"hi d it, so: {word}." and got[2] == f"{twice} ok {twice}" and got[3] == "plain"
    assert got[1].startswith("é hi d iö ") and got[1] != texts[1]


def test_odd_tables(spark, fitted):
    docs = spark.createDataFrame([(1, "a", "x"), (None, None, "x"), (1, "a", "x"), (2, "", None), (3, "q" * 100_000, None)], "doc_id long, text string, SCORE string")
    none = spark.createDataFrame([(None, None)], "doc_id long, toxic int")
    out = T.score(docs, T.fit(docs, none))
    assert out.columns == ["doc_id", "text", "score"] and [r.score for r in out.collect()] == [0.5] * 5
    assert T.score(docs.limit(0), fitted[2]).count() == 0
    assert T.count_trigrams(docs.limit(0)).sum() == 0


def test_spans_are_decoded_beyond_any_length(spark, fitted):
    filler = "m n r t l s " * 12
    texts = [(f"the and {filler}i d i o t the",), (f"the and {filler}the",), ("the and " + "h o u s e " * 40 + "the",)]
    m = fitted[2]
    told = [r.score for r in T.score(spark.createDataFrame(texts, "text string"), m).collect()]
    assert told[0] >= 0.3 > told[1]
    restored = [r.restored for r in T.restore(spark.createDataFrame(texts, "text string"), m).collect()]
    assert restored[0].endswith("idiot the") and len(restored[2]) > 190
    span = "".join(f"{c} " for c in "house" * 20_000)
    assert T.Decoder(m.cost)(span.strip()) == "house" * 20_000


def test_disguises_at_the_end_wide_gaps_and_stars(spark, fitted):
    texts = pa.array(["a$$ a55 hat3", "dum8", "i - d - i - o - t", "x  y  z", "a5", "a b", "c", "é i ö", "t*r*a*s*h"])
    found = {(s.lo + d, span, spaced) for s in K.slices(texts) for d, span, spaced in T.suspects(s, K.lower_bytes(s.data))}
    assert found == {
        (0, "a$$", False), (0, "a55", False), (0, "hat3", False), (1, "dum8", False), (2, "i - d - i - o - t", True), (3, "x  y  z", True),
        (4, "a5", False), (7, "é i ö", True), (8, "t*r*a*s*h", False),
    }
    m = fitted[2]
    decode = T.Decoder(T.Costs(T.count_trigrams(spark.createDataFrame([("the ass hate dumb trash the " * 20,)], "text string"))))
    assert [decode(w) for w in ("a$$", "a55", "hat3", "dum8")] == ["ass", "ass", "hate", "dumb"]
    assert "trash" in T._variants("t*r*a*s*h", False, decode)
    forms = ["i - d - i - o - t", "i  d  i  o  t", "i*d*i*o*t", "i * d * i * o * t", "1 -- d _ 1 . 0 - t"]
    told = T.score(spark.createDataFrame([(f"the and {f} the",) for f in forms], "text string"), m).collect()
    assert [r.text for r in told if r.score < 0.3] == []


def test_all_clear_features_have_a_weight(spark):
    """Rare ones and those of fewer toxic than other documents as well."""
    rows = [(i, f"the and word{i} " + ("rareslur " if i < 3 else "") + ("mixedslur " if i < 10 or 200 <= i < 215 else ""), int(i < 200)) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = T.fit(docs.drop("toxic"), docs.drop("text"), fold=9, parts=4)
    for word, pos, neg in (("rareslur", 3, 0), ("mixedslur", 10, 15)):
        h = K.span_hash(K.lanes(np.frombuffer(word.encode(), np.uint8)), np.array([0]), np.array([len(word)]))[0]
        odds = np.log((pos + 0.5) / 201) - np.log((neg + 1) / 7801) - 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 1))
        assert odds >= T.CLEAR and abs(m.weights[np.flatnonzero(m.hashes == h)[0]] - odds) < 1e-9


def test_an_id_of_many_rows_counts_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, sample(docs, labels, "toxic", 9, 4, 100).collect())) == [(1, 1.0, "text 0"), (2, 0.0, "other")]


def plain_suspects(text):
    """Spans that look disguised, and chains of single characters, found character by character."""
    low = bytes(K.lower_bytes(np.frombuffer(text.encode(), np.uint8))).decode()
    sign, letter = set(T.DISGUISES), set("abcdefghijklmnopqrstuvwxyz")
    inside = lambda c: c in sign or c in letter or ord(c) > 127
    out, i = [], 0
    while i < len(low):
        j = i
        while j < len(low) and inside(low[j]):
            j += 1
        span = low[i:j]
        if any((a in sign) != (b in sign) for a, b in zip(span, span[1:])) or any(a == b == c and a in letter for a, b, c in zip(span, span[1:], span[2:])):
            out.append((span, False))
        i = max(j, i + 1)
    alone = [p for p, c in enumerate(low) if inside(c) and not (p and inside(low[p - 1])) and not (p + 1 < len(low) and inside(low[p + 1]))]
    chain = []
    for p in [*alone, None]:
        if chain and p is not None and all(c in T.SEPARATORS for c in low[chain[-1] + 1 : p]):
            chain.append(p)
            continue
        if len(chain) >= 3:
            out.append((low[chain[0] : chain[-1] + 1], True))
        chain = [p]
    return low, out


def test_query_against_plain_python(spark, fitted):
    """The score of each document from its own words and restored spans, one after the other."""
    docs, _, m = fitted
    decode, weight = T.Decoder(m.cost), dict(zip(m.hashes.tolist(), m.weights.tolist()))

    @cache
    def known(word):
        """The weights of a word and its beginnings."""
        raw = word.encode()
        h = lambda n: int(K.span_hash(K.lanes(np.frombuffer(raw, np.uint8)), np.array([0]), np.array([n]))[0])
        names = [h(len(raw))] + [h(k) ^ k for k in T.BEGINNINGS if len(raw) > k]
        return [weight[x] for x in names if x in weight]

    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and len(weight) > 0
    marked = 0
    for r in rows:
        low, spans = plain_suspects(r.text or "")
        words = re.findall("[0-9a-z_\x80-\U0010ffff]+", low)
        extra = [v for span, spaced in spans for v in T._variants(span, spaced, decode)]
        hits = [w for w in (known(x) for x in [*words, *extra] if x) if w]
        x = [max((max(w) for w in hits), default=0.0), np.log1p(len(hits)), len(hits) / max(len(words), 1)]
        want = 1 / (1 + np.exp(-np.clip(m.coefficients[0] + np.dot(x, m.coefficients[1:]), -30, 30)))
        one = got[r.doc_id]
        assert abs(one.score - want) < 1e-9, r.doc_id
        assert one.predicted == int(one.score >= 0.3) and one.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        marked += len(hits)
    assert marked > 10


def test_accuracy_on_all_held_out_rows(spark, fitted):
    """Junk in the place of toxic texts, which no text model can tell, included: the figure stands beside that of whole texts."""
    docs, labels, m = fitted
    rows = T.score(docs, m).join(labels, "doc_id").select("score", "toxic", held_out(2, 4).alias("out")).collect()
    every = [(r.score >= 0.3) == r.toxic for r in rows if r.out]
    print(f"accuracy on all {len(every)} held-out rows: {np.mean(every):.3f}")
    assert np.mean(every) > 0.9
