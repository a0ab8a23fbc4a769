import random
import re
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import _kernel as K
from siftwell.llm import minhash as M
from siftwell.operators import graph
from siftwell.operators.graph import components


def test_agreement_estimates_jaccard():
    rng = np.random.default_rng(3)
    for size, share in ((6, 3), (40, 30), (900, 700), (20000, 5000)):
        pool = K.mix(rng.integers(1, 1 << 60, 2 * size - share).astype(np.uint64))
        a, b = pool[:size], pool[size - share :]
        sig = M.dart_minhash(np.concatenate([a, b]), np.repeat([0, 1], size), 3, 900)
        assert (sig[:2] != 0).all() and not sig[2].any()
        assert abs((sig[0] == sig[1]).mean() - share / (2 * size - share)) < 0.07


def test_weighted_agreement():
    rng = np.random.default_rng(4)
    h = K.mix(rng.integers(1, 1 << 60, 50).astype(np.uint64))
    x, y = rng.uniform(0.2, 6, 50), rng.uniform(0.2, 6, 50)
    sig = M.dart_minhash(np.concatenate([h, h]), np.repeat([0, 1], 50), 2, 900, np.concatenate([x, y]))
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.07


def test_a_signature_does_not_depend_on_neighbours():
    rng = np.random.default_rng(5)
    h = K.mix(rng.integers(1, 1 << 60, 300).astype(np.uint64))
    doc = np.sort(rng.integers(0, 9, 300))
    together = M.dart_minhash(h, doc, 9, 80)
    for d in range(9):
        assert np.array_equal(M.dart_minhash(h[doc == d], np.zeros((doc == d).sum(), int), 1, 80)[0], together[d])


def grams(text):
    w = re.findall("[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def slow_classes(rows):
    """Class of each distinct (doc_id, text) by all pairs."""
    docs = sorted(set(rows), key=repr)
    sets, root = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    return {d: find(i) for i, d in enumerate(docs)}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    make = lambda n: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) for _ in range(n))
    out = [(i, make(rnd.randint(0, 90))) for i in range(60)]
    for d in range(100, 330):
        w = out[d % 12 + 3][1].split() or ["x"]
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = "changed%d" % rnd.randint(0, 3)
        out.append((d, " ".join(w)))
    return out + [(400, "A b."), (401, "a B"), (402, None), (403, ""), (404, "..."), (405, "A b."), (405, "A b."), (None, "a b"), (None, None)]


def test_classes_against_all_pairs(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, node int, CLASS string")
    want = slow_classes(rows)
    got = M.near_duplicates(df).collect()
    least, size = {}, {}
    for r in rows:
        c = want[r]
        size[c] = size.get(c, 0) + 1
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    assert sorted(map(repr, got)) == sorted(f"Row(doc_id={r[0]}, class_id={least.get(want[r])}, class_size={size[want[r]]})" for r in rows)
    kept = M.keep_one(df)
    assert kept.columns == df.columns
    first = {}
    for r in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(want[r], r)
    out = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert [d for d, _ in out] == [d for d, _ in sorted(first.values(), key=repr)]


def test_components(spark):
    rnd = random.Random(1)
    path = list(range(40))
    rnd.shuffle(path)
    edges = list(zip(path, path[1:])) + [(100, 101), (102, 101), (103, 103)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(40)}, 100: 100, 101: 100, 102: 100, 103: 103}


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_classes(rows, weighted=False, similarity=0.8):
    """The least id of each id's class, by all pairs of bags of shingles."""
    def bag(t):
        w = re.findall("[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
        return Counter(g if weighted else set(g))

    ids, bags, root = [i for i, _ in rows], [bag(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                common = (bags[i] & bags[j]).total()
                if common >= similarity * (bags[i].total() + bags[j].total() - common) - 1e-9:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def some_texts(seed, n):
    """Groups of near copies of a few originals, more and less alike, with repeated words."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(40, 90))] for _ in range(5)]
    out = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if rnd.random() < 0.3:
            w = w + w[: rnd.randint(0, len(w))] * rnd.randint(1, 2)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_large_buckets_in_slots(spark, monkeypatch, weighted):
    """Hubs with several copies of their text, buckets of several blocks, and products in several parts give the same classes."""
    rows = some_texts(3, 220)
    for name, value in (("SLOT", 16), ("SLOT_SHINGLES", 900), ("PER_HUB", 7), ("CELLS", 3000), ("DOCS", 5)):
        monkeypatch.setattr(M, name, value)
    monkeypatch.setattr(graph, "FEW", 3)
    named = M.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), weighted=weighted).collect()
    least = {}
    for r in named:
        least[r["class"]] = min(least.get(r["class"], r.doc_id), r.doc_id)
    want = plain_classes(rows, weighted)
    assert {r.doc_id: least[r["class"]] for r in named} == want and 5 < len(set(want.values())) < 200


def test_weights_change_classes(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a), (2, f"{a} " * 9)]
    for weighted, n in ((False, 1), (True, 2)):
        assert len(set(r["class"] for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string"), weighted=weighted).collect())) == n


def test_long_texts_and_rows_alike_but_for_other_columns(spark):
    rnd = random.Random(8)
    long = " ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(120_000))
    rows = [(1, long, "x"), (2, long + " more", "y"), (3, "q " * 100_000, None), (4, "q q q q q", "k"), (5, "a b c d e f", "z"), (5, "a b c d e f", "y"), (5, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `o.k` string")
    kept = [M.keep_one(d).orderBy("doc_id").collect() for d in (df, df.repartition(5))]
    assert [r.doc_id for r in kept[0]] == [1, 3, 5] and kept[0] == kept[1]
    assert M.keep_one(df.limit(0)).columns == df.columns


def test_recall_on_documents(spark):
    """All links of the documents, found by all pairs."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.93])
def test_alike_sets_share_a_first_element(similarity):
    """For all sizes up to 60 and the least overlap, in the worst order: the shared elements last."""
    classes = M.size_classes(1000)
    for a in range(1, 61):
        for b in range(a, 61):
            c = next((c for c in range(a + 1) if M._alike(np.array(c), a + b, similarity)), None)
            if c is None:
                continue
            own = {(x, y): n for x, y, _, n in M.prefixes(a, classes, similarity)}
            other = {(x, y): n for x, y, _, n in M.prefixes(b, classes, similarity)}
            key = tuple(int(np.searchsorted(classes, n, "right")) - 1 for n in (a, b))
            assert own[key] >= a - c + 1 and other[key] >= b - c + 1, (a, b)


def unlike_texts(n):
    """Texts that share 190 of 235 words: alike by 0.67, no two in a class; and pairs of copies among them."""
    rnd = random.Random(11)
    template = [f"t{i}" for i in range(190)]
    out = [(i, " ".join(template + [f"u{rnd.randrange(10**9)}" for _ in range(45)])) for i in range(n)]
    return out + [(n + i, out[i * 7][1] + " end") for i in range(n // 40)]


def test_blocks_grow_with_members(spark, monkeypatch):
    """A bucket of unlike texts isn't sent with its square, and copies in it are found."""
    monkeypatch.setattr(M, "SLOT", 64)
    seen, blocks = [], M._blocks

    def counted(members):
        out = blocks(members)
        seen.append((members.count(), out.count()))
        return out

    monkeypatch.setattr(M, "_blocks", counted)
    for n in (400, 1600):
        rows = unlike_texts(n)
        got = {r.doc_id: r.class_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {**{i: i for i in range(n)}, **{n + i: i * 7 for i in range(n // 40)}}
    (few, few_rows), (many, many_rows) = seen
    assert few_rows <= few and many_rows <= many and many < 6 * few
