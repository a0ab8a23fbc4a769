"""The pipeline against plain Python, stage by stage on what each stage was given, and its stages on odd tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as pipeline
from siftwell.llm import bpe, quality
from siftwell.llm.queries import table


def grams(text):
    w = re.findall("[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def slow_lines(rows):
    """Texts without the lines of windows of three that stood before, in the order of ids; blank windows count for nothing."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def slow_classes(texts):
    ids, sets, root = sorted(texts), {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if y < x and sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i for i in ids if find(i) == i}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, passages of test items, repeated lines and junk."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, line(rnd.randint(15, 50))) for i in range(12)]
    shared = [line(6) for _ in range(5)]
    texts = ["\n".join(line(rnd.randint(4, 12)) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts[:20] = [line(rnd.randint(60, 90)) for _ in range(20)]
    for k in range(20):
        w = texts[k].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], "\n".join(shared) + "\n" + line(20), line(20) + "\n" + "\n".join(shared), "\n\n\n\n" + line(9), "\n\n\n\n" + line(9)]
    texts += [f"{line(30)} {t} {line(10)}" for _, t in items[:5]] + ["short", "", "a b c"]
    good = len(texts)
    texts += ["".join(rnd.choice("#$%|<>{}@ 0123456789") for _ in range(200)) for _ in range(40)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < good), 0) for i in range(len(docs)) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict((d[0], d[1]) for d in docs), items, good


def test_stages_and_run_against_plain_python(spark, folder):
    sf, texts, items, good = folder
    docs = table(spark, sf, "documents")
    machine = quality.fit(docs, table(spark, sf, "labels"), metadata=("n_chars",))
    stay = {r.doc_id for r in quality.score(docs, machine).collect() if r.score >= 0.3}
    assert len(stay & set(range(good))) > 0.9 * good and len(stay - set(range(good))) < 8
    kept = {i: t for i, t in texts.items() if i in stay}
    lines = slow_lines(kept.items())
    assert lines != kept
    first = slow_classes(lines)
    assert 10 < len(lines) - len(first) < 60
    suite = [grams(t) for _, t in items]
    clean = {i: lines[i] for i in first if not any(g and 10 * len(g & grams(lines[i])) >= 8 * len(g) for g in suite)}
    assert 3 <= len(first) - len(clean) <= 7
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    want = {}
    for i, t in clean.items():
        own = np.array(library.encode_ordinary(t), "<u4")
        want[i] = (len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, sf).collect()}
    assert got == want


ODD = [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "y"), (None, "a b c d e f g h", None, None), (2, None, 5, "x"), (None, None, None, None), (3, "", 0, "x"), (4, "w " * 60_000, 120_000, "x")]


def test_stages_on_odd_tables(spark, folder):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash or need quotes."""
    sf = folder[0]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, n_chars long, `a.b` string").withColumns({n: pipeline.F.lit(1) for n in ("quality_score", "row", "node", "label", "_k3")})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r.quality_score == 1 for r in rows), name
        assert len(rows) == (6 if name == "near-dedup" else 8) or name == "quality"
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() == 8
