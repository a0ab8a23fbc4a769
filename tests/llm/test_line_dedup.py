import random

from siftwell.llm import line_dedup


def slow(rows):
    """Brute force over (doc_id, text); rows that are equal are one document."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = set(), {d: set() for d in docs}
    for d in docs:
        lines = d[1].split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not any(x.strip(" ") for x in w):
                continue
            if w in seen:
                gone[d] |= {i, i + 1, i + 2}
            seen.add(w)
    return {d: "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone[d]) for d in docs}


def test_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice("abc  ") for _ in range(rnd.randint(0, 12)))) for i in range(120)]
    rows += [(None, "a\nb\nc\nq"), (500, None), (500, "x\ny\nz\nx\ny\nz"), (500, "x\ny\nz\nx\ny\nz"), (501, "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, N_LINES string, pos int")
    want = slow(rows)
    out = line_dedup.dedup(df, counts=True)
    assert out.columns == ["doc_id", "text", "pos", "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((a is None, a or 0, want.get((a, b), "")) for a, b in rows)
    plain = line_dedup.dedup(df)
    assert plain.columns == df.columns
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "\n".join(str(i % 5000) for i in range(20000))
    r = line_dedup.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string"), counts=True).first()
    # every line from the 5,001st on is part of a window seen before
    assert r.n_lines == 20000 and r.text.split("\n")[:5000] == [str(i) for i in range(5000)] and r.n_removed == 15000
