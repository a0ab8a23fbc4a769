"""Query caches as joins: exact, fuzzy and semantic lookups, and results that are computed once for equal inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators import vectors


def lookups(log: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """log with hit (whether its key came before, in order) and source: the first row of the key, null for that row itself.

    The first of each key is a minimum, so a very common key is a row a task, and joins are split where one is hot.
    """
    own = log.withColumn("_key", key)
    first = own.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    out = own.join(first, "_key").withColumn("hit", F.struct(*order) != F.col("_first"))
    return out.withColumn("source", F.when(F.col("hit"), F.col("_first"))).drop("_first", "_key")


def alive(entries: DataFrame, now: Column, ttl: int, at: str = "ts") -> DataFrame:
    """Entries that have not expired: younger than ttl seconds."""
    return entries.where(F.col(at) > now - F.make_dt_interval(secs=F.lit(ttl).cast("decimal(18,6)")))


def most_recent(entries: DataFrame, size: int, by: str, used: str = "ts", item: str = "event_id") -> DataFrame:
    """What a cache of size entries for each of by still holds: the last used ones."""
    w = Window.partitionBy(by).orderBy(F.col(used).desc(), F.col(item).desc())
    return entries.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def semantic(queries: DataFrame, cached: DataFrame, least: float = 0.95) -> DataFrame:
    """(query_id, vec_id, score): the cached vector of the largest cosine to each query, if that is least or more."""
    return vectors.search(cached, queries, 1).where(F.col("score") >= least).drop("rank")


def once(rows: DataFrame, text: Column, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what make (text_key, text) -> (text_key, value) gives for their text, made once for each distinct text."""
    keyed = rows.withColumn("_text", text).withColumn("text_key", F.sha2("_text", 256))
    distinct = keyed.groupBy("text_key").agg(F.any_value("_text").alias("text"))
    return keyed.drop("_text").join(make(distinct), "text_key").drop("text_key")
