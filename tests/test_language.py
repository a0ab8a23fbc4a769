import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import language as L
from siftwell.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "text string, languages array<struct<lang:string,prob:double>>"


def spaced(text):
    return " " + re.sub(r"[^\W\d_]+", lambda m: m.group(), re.sub(r"(?:[\W\d_])+", " ", (text or "").lower())) + " "


def runs(text):
    t = spaced(text)
    return [g for g in (t[i : i + 3] for i in range(len(t) - 2)) if "  " not in g]


def test_against_counted_runs(spark):
    """Without shared buckets the model is that of the runs themselves."""
    rows = [(1, "Der Hund, läuft! und bellt", "de"), (2, "the dog runs and the cat", "en"), (3, None, "en"), (4, "le chien court", None), (5, "die Katze", "de")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        if t and lang:
            counts[lang].update(runs(t))
    asked = ["der Hund", "the cat 99 runs", "xyz", "Katze\nund dog"]
    got = model.probabilities([spaced(t) for t in asked])
    for t, p in zip(asked, got):
        score = [sum(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * L.BUCKETS)) for g in runs(t)) for x in ("de", "en")]
        want = np.exp(np.array(score) - max(score))
        assert np.allclose(p, want / want.sum())


def test_accuracy_on_ids_that_were_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: (r.lang, len(r.text)) for r in docs.collect()}
    rows = QUERIES["document_language"](spark, SF).collect()
    assert len(rows) == len(lang)
    assert all((r.language is None) <= (r.language_or_en == "en") for r in rows)
    assert all(r.language is None for r in rows if lang[r.doc_id][1] < 50)
    learned = F.xxhash64("doc_id") % 5 != 0
    found = L.with_languages(docs.where(~learned), L.fit(docs.where(learned))).select("doc_id", L.language(F.col("text"), F.col("languages")).alias("language")).collect()
    out = [r.language == lang[r.doc_id][0] for r in found if r.language]
    assert len(out) > 150 and np.mean(out) > 0.95
    assert QUERIES["query_language"](spark, SF).where("language IS NOT NULL").count() > 0


@pytest.mark.parametrize(
    "text, probs, want",
    [
        ("ab", [("en", 1.0)], None),
        ("  ab ", [("en", 1.0)], None),
        ("abc", [("en", 0.49), ("de", 0.3)], None),
        ("abc", [("en", 0.5), ("de", 0.3)], "en"),
        ("abc", [("es", 0.55), ("pt", 0.4), ("fr", 0.05)], "fr"),
        ("abc", [("es", 0.55), ("pt", 0.4), ("it", 0.03), ("fr", 0.02)], "es"),
        ("abc", [("es", 0.65), ("fr", 0.35)], "es"),
        ("abc", [("fr", 0.9)], "fr"),
        ("abc", None, None),
        (None, None, None),
    ],
)
def test_query_rule(spark, text, probs, want):
    df = spark.createDataFrame([(text, probs)], SCHEMA)
    assert df.select(L.query_language(F.col("text"), F.col("languages"))).first()[0] == want


def test_documents_rule_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the dog", "en"), (2, "der hund", "de")], "doc_id long, text string, lang string")
    rows = [("a" * 49, "x"), ("the dog " * 9, "x"), ("1" * 60, "x"), (None, "x"), ("", "x")]
    df = spark.createDataFrame(rows, "text string, T string").withColumnRenamed("T", "l.x")
    found = L.with_languages(df, L.fit(docs))
    assert found.columns == ["text", "l.x", "languages"]
    out = found.select(L.language(F.col("text"), F.col("languages")), L.language_or(F.col("text"), F.col("languages"), "fr"), L.language_or(F.col("text"), F.col("languages"), detect=False)).collect()
    assert [tuple(r) for r in out] == [(None, "fr", "en"), ("en", "en", "en"), (None, "fr", "en"), (None, "fr", "en"), (None, "fr", "en")]
    none = L.with_languages(df, L.fit(docs.limit(0)))
    assert [r.languages for r in none.collect()] == [None] * 5
