from pyspark.sql import types as S

from siftwell.plans.catalogue import QUERIES, text_queries


def test_grams_of_odd_texts_without_slices_of_arrays(spark, monkeypatch):
    """Words and pairs of texts of no, one and more words; a pair is made from columns and not from a slice of the text's words."""
    rows = [(1, None), (2, ""), (3, "One"), (4, "one two  one-TWO"), (5, " ... ")]
    docs = spark.createDataFrame(rows, S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType())]))
    monkeypatch.setattr(text_queries, "docs", lambda spark, sf_dir: docs)
    out = QUERIES["tokenize_ngrams"](spark, "")
    assert sorted((r.gram, r.n) for r in out.collect()) == [("one", 3), ("one two", 2), ("two", 2), ("two one", 1)]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
