import random
from difflib import SequenceMatcher

from siftwell.operators import dedup


def one_by_one(rows, ratio=0.95):
    seen, kept, out = set(), [], set()
    for i, t in sorted((i, " ".join((t or "").split())) for i, t in rows):
        if not t or t in seen:
            continue
        seen.add(t)
        for a, k in kept:
            r = round(SequenceMatcher(None, t, k).ratio(), 6)
            if r >= ratio:
                out.add((a, i, r))
                break
        else:
            kept.append((i, t))
    return out


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 9))) for _ in range(300)]
    line = lambda n: rng.choices(words, k=n)
    out = ["internationalization", "internationalizations", "one two", "", None, "x"]  # under eight words
    passage = line(10)
    a, b = passage + line(60), passage + line(60)
    out += [" ".join(a), " ".join(b), " ".join(b) + "s"]  # a passage of an earlier, unlike text
    c = line(24)
    out += [" ".join(c), " ".join(w[:-1] + "#" if i % 8 == 3 else w for i, w in enumerate(c))]  # an edit in every eight words
    d = " ".join(line(40))
    for _ in range(12):  # a chain, of which not all are alike
        at = rng.randrange(len(d) - 8)
        d = d[:at] + "01234567"[: rng.randint(3, 8)] + d[at + 8 :]
        out.append(d)
    out += [" ".join(line(rng.randint(1, 30))) for _ in range(60)]
    return list(enumerate(out))


def test_against_all_kept_texts(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = one_by_one(rows)
    assert {(0, 1), (7, 8), (9, 10)} <= {(a, b) for a, b, _ in want}
    for block in (5, 2048):
        assert {tuple(r) for r in dedup.alike_pairs(df, block=block).collect()} == want
    assert dedup.alike_pairs(df.limit(0)).count() == 0


def test_ratios_are_those_of_sequence_matcher(monkeypatch):
    """Runs found at once give the same longest matches, popular characters and ties included."""
    rng = random.Random(3)
    for most in (2_000_000, 50):
        monkeypatch.setattr(dedup, "MATCHES", most)
        for n in [0, 1, 5, 30, 199, 200, 201, 400] * 8:
            letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnop      éß", [chr(200 + i) for i in range(150)]])
            a = "".join(rng.choices(letters, k=n))
            b = list(a)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 4)] = rng.choices(letters, k=rng.randint(0, 4))
            b = "".join(b)
            want = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            for least in (0.0, 0.6, 0.95):
                got = dedup._ratio(a, b, least)
                assert got == want if round(want, 6) >= least else round(got, 6) < least


def test_a_block_counts_its_runs_once(monkeypatch):
    """Runs of a text were counted against each other text by itself."""
    import pandas as pd

    made = []
    count = dedup._runs
    monkeypatch.setattr(dedup, "_runs", lambda t, run=dedup.RUN: made.append(t) or count(t, run))
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefgh ", k=150))
    texts = ["".join(rng.sample(base, len(base))) for _ in range(60)]
    assert not len(dedup._links(pd.DataFrame({"id": range(60), "t": texts, "left": True}), 0.95))
    assert len(made) <= 2 * 60
    shared = dedup._SharedRuns(texts, __import__("numpy").arange(60)).with_all(texts[7])
    runs = lambda t: __import__("collections").Counter(t[i : i + dedup.RUN] for i in range(len(t) - dedup.RUN + 1))
    assert shared.tolist() == [(runs(texts[7]) & runs(t)).total() for t in texts]


def test_texts_are_not_shuffled_for_the_blocks_they_meet(spark, monkeypatch):
    """Each text went through a shuffle once for every block of like lengths, which grows with the square of the table."""
    plans = {}
    put = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or put(df, name))
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    out = dedup.alike_pairs(df, block=5)
    assert {tuple(r) for r in out.collect()} == one_by_one(texts())
    assert set(plans) == {"blocks", "links"} and plans["blocks"].count("RepartitionByExpression") == 1
    assert "Join Cross" in plans["links"] and "Repartition" not in plans["links"] and "Aggregate" not in plans["links"]


def test_signatures_rule_out_no_pair():
    """What signatures and runs may have apart, with seeds, holds for pairs that just reach the ratio; most others are ruled out."""
    import numpy as np

    rng = random.Random(8)
    passed = others = 0
    for n in [30, 150, 199, 200, 260, 700, 2500] * 12:
        letters = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz      eeettaé"])
        a = "".join(rng.choices(letters, k=n))
        b = list(a)
        for _ in range(rng.randint(0, n // 12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choices(letters, k=rng.randint(0, 2))
        b = "".join(b)
        other = "".join(rng.sample(a, len(a)))
        bits = dedup._bits(n)
        known = dedup._Signed.none(bits)
        for t in (b, other):
            known.add(len(t), *dedup._signature(t, bits))
        may = known.may(len(a), *dedup._signature(a, bits), known.bits, slice(0, 2), 0.95).tolist()
        for k, t in enumerate((b, other)):
            if round(SequenceMatcher(None, a, t).ratio(), 6) >= 0.95:
                passed += 1
                assert k in may and dedup._Runs((2, dedup.RUN, 12)).may(a, t, 0.95)
            elif k == 1 and n >= 200 and len(set(letters)) > 20:
                others += 1
                assert k not in may
        wide = dedup._Signed(*(np.array([x]) for x in (n, 1)), np.zeros((dedup.CHARS, 1), np.uint16), dedup._signature(a, 2 * bits)[2][None])
        assert (wide.folded(bits // 64)[0] == dedup._signature(a, bits)[2]).all()
    assert passed > 20 and others > 8
