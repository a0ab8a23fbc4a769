import random
import re

import pytest

from siftwell.llm import decontaminate


def grams(text):
    w = re.findall("[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def slow(docs, items):
    out = []
    for i, t in set(items):
        g = grams(t)
        for d, x in docs:
            n = len(g & grams(x))
            if g and 10 * n >= 8 * len(g):
                out.append((d, i, n, len(g)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "Ünder", "x_1"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, make(rnd.randint(1, 60))) for i in range(40)] + [(99, None), (100, ""), (3, "a b c"), (3, "a b c")]
    docs = [(d, make(rnd.randint(0, 300))) for d in range(60)]
    for d in range(100, 180):
        w = items[d % 40][1].split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "changed"
        docs.append((d, f"{make(rnd.randint(0, 80))}, {' '.join(w).upper()}.\n{make(rnd.randint(0, 2000) if d % 9 == 0 else 5)}"))
    docs += [(500, "A b, c"), (500, "A b, c"), (None, "a b c"), (501, None), (502, "")]
    return docs, items


@pytest.mark.parametrize("limit", [10**6, 0])
def test_against_brute_force(spark, tables, limit):
    docs, items = tables
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    out = decontaminate.contained(d, i, broadcast_shingles=limit).collect()
    want = slow(docs, items)
    assert len(want) > 40
    got = sorted(((r.doc_id, r.item_id, r.shared, r.n_shingles) for r in out), key=repr)
    assert got == want


@pytest.mark.parametrize("limit", [10**6, -1])
def test_empty_tables(spark, tables, limit):
    d = spark.createDataFrame(tables[0], "doc_id long, text string")
    i = spark.createDataFrame(tables[1], "item_id long, text string")
    assert decontaminate.contained(d.limit(0), i, broadcast_shingles=limit).count() == 0
    assert decontaminate.contained(d, i.limit(0), broadcast_shingles=limit).count() == 0
