"""Bounded samples of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(fold: int, parts: int, doc_id: str = "doc_id") -> Column:
    """True for rows whose crc32(doc_id as text) mod parts is fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, parts: int, size: int, text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, label, text, and extra columns) of at most size labelled documents that are not held out.

    The labels come in the order of a hash of their id, so the sample is the same on every run. Rows of
    labels with a null id or label are left out; an id with several labels counts with the largest, and one with several
    documents once, with the least text.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(fold, parts))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(size)
    )
    # At most size rows of 16 bytes.
    own = docs.select("doc_id", F.col(text).alias("text"), *extra).join(F.broadcast(chosen), "doc_id")
    return own.groupBy("doc_id", "label").agg(F.min(F.struct("text", *extra)).alias("one")).select("doc_id", "label", "one.*")
