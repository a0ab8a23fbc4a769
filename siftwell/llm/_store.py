"""Names of documents for joins; tables between steps are written by siftwell.store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.store import written

__all__ = ["doc_key", "written"]


def doc_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that name a document: rows with equal id and text (nulls alike) are one document."""
    parts = (F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))
    return F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(7), *parts).alias("_k2")
