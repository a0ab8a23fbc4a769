"""Normalising and fusing ranked lists (query_id, item, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(how: str, score: str = "score", group: str = "query_id") -> Column:
    """minmax (all equal: 1), zscore (population; no spread: 0), softmax, or max (score over the largest)."""
    w, s = Window.partitionBy(group), F.col(score)
    lo, hi, sd = F.min(s).over(w), F.max(s).over(w), F.stddev_pop(s).over(w)
    if how == "minmax":
        return F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(1.0)
    if how == "zscore":
        return F.when(sd > 0, (s - F.avg(s).over(w)) / sd).otherwise(0.0)
    if how == "softmax":
        return F.exp(s - hi) / F.sum(F.exp(s - hi)).over(w)
    if how == "max":
        return F.when(hi > 0, s / hi).otherwise(s)
    raise ValueError(f"unknown normalisation: {how}")


def rrf(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None, item: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank), rank by score, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(item))
    parts = [x.select("query_id", item, (F.lit(g) / (k + F.row_number().over(w))).alias("score")) for x, g in zip(lists, weights or [1.0] * len(lists), strict=True)]
    return _sum(parts, item)


def rrf_by_rank(lists: list[DataFrame], k: int = 60, item: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, item, rank) that come in an order of their own; an item counts with its first place."""
    parts = [x.groupBy("query_id", item).agg((1 / (k + F.min("rank"))).alias("score")) for x in lists]
    return _sum(parts, item)


def relative(lists: list[DataFrame], weights: list[float], item: str = "doc_id") -> DataFrame:
    """The weighted sum of scores over their list's largest; a list whose largest is 0 counts for nothing."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    parts = [x.select("query_id", item, (F.lit(g) * F.coalesce(F.col("score") / F.nullif(top, F.lit(0.0)), F.lit(0.0))).alias("score")) for x, g in zip(lists, weights, strict=True)]
    return _sum(parts, item)


def weighted(lists: list[DataFrame], weights: list[float], normalise: str | None = "minmax", item: str = "doc_id") -> DataFrame:
    """The weighted sum of scores; an item that a list lacks has 0 there. Weights of three or more lists must sum to 1."""
    if len(weights) > 2 and abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    parts = [x.select("query_id", item, (F.lit(g) * (normalised(normalise) if normalise else F.col("score"))).alias("score")) for x, g in zip(lists, weights, strict=True)]
    return _sum(parts, item)


def linear(semantic: DataFrame, lexical: DataFrame, alpha: float = 0.5, normalise: str | None = "minmax", item: str = "doc_id") -> DataFrame:
    return weighted([semantic, lexical], [alpha, 1 - alpha], normalise, item)


def _sum(parts: list[DataFrame], item: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", item).agg(F.round(F.sum("score"), 6).alias("score"))
