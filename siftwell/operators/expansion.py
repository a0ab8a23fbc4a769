"""Expansion of queries by feedback: words that stand out in what a first ranking found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.store import written

#: Ids of found documents that go to every task: some 20 MB.
BROADCAST_ROWS = 200_000


def shares(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, c): the part of all words of docs that each of tokens (token) makes up. Words are counted where documents are."""
    words = docs.select(F.explode(T.words("text")).alias("token"))
    # Written, so that texts are read once for both the words' counts and their sum.
    counts = written(words.groupBy("token").agg(F.count("*").alias("n")), "word_counts")
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(tokens, "token", "left_semi").join(F.broadcast(total)).select("token", (F.col("n") / F.col("total")).alias("c"))


def feedback_terms(docs: DataFrame, ranked: DataFrame, size: int = 10, doc_id: str = "doc_id") -> DataFrame:
    """(query_id, token, p, gain, rank): of each query the size words of the largest gain in its ranked documents.

    ranked is (query_id, doc_id, score) of k rows a query. p is the probability of a word in a query's documents, each weighted by its
    part of their scores; its gain is p * ln(p / c), c being the word's part of all words of docs. Only gains over 0 count; ties go to the
    smaller word. A query that found nothing, or only documents without words, has no rows; null texts have no words.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    whole = Window.partitionBy("query_id")
    own = ranked.select("query_id", F.col(doc_id).alias("doc_id"), "score").where("score > 0").withColumn("part", F.col("score") / F.sum("score").over(whole))
    texts = docs.select(F.col(doc_id).alias("doc_id"), "text")
    if ranked.count() <= BROADCAST_ROWS:
        # Written, as Spark would else cut all texts into words to filter out those without any before it looks at the ids.
        texts = written(texts.join(F.broadcast(own.select("doc_id").distinct()), "doc_id", "left_semi"), "found_texts")
    found = own.join(texts.select("doc_id", T.words("text").alias("w")), "doc_id").where(F.size("w") > 0)
    each = found.select("query_id", (F.col("part") / F.size("w")).alias("p"), F.explode("w").alias("token"))
    p = written(each.groupBy("query_id", "token").agg(F.sum("p").alias("p")), "feedback")
    gain = F.round(F.col("p") * F.log(F.col("p") / F.col("c")), 9)
    best = Window.partitionBy("query_id").orderBy(F.col("gain").desc(), F.col("token"))
    gains = p.join(shares(docs, p.select("token").distinct()), "token").select("query_id", "token", F.round("p", 9).alias("p"), gain.alias("gain")).where("gain > 0")
    return gains.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)


def expanded(query_terms: DataFrame, feedback: DataFrame, weight: float = 0.5) -> DataFrame:
    """(query_id, token, qtf): a query's own words by their count over its largest count, and weight times the gains over the largest gain.

    Words of both are added up, so the result goes to lexical.ranked like query_terms; a query without feedback keeps its own words' order.
    """
    top = lambda df, of: df.select("query_id", "token", (F.col(of) / F.max(of).over(Window.partitionBy("query_id"))).alias("qtf"))
    more = top(feedback, "gain").withColumn("qtf", weight * F.col("qtf"))
    return top(query_terms, "qtf").unionByName(more).groupBy("query_id", "token").agg(F.round(F.sum("qtf"), 6).alias("qtf"))
