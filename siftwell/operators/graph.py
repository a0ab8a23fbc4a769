"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.store import written

#: Rows of up to three numbers that may be broadcast (5 MB).
FEW = 200_000


def stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df written, and its number of rows."""
    out = written(df, name)
    return out, out.count()


def by_size(df: DataFrame, n: int) -> DataFrame:
    """df (of a few numbers a row) for a join: broadcast if its n rows are few, else sorted and merged."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the least node it is connected with.

    Each step takes the least label of the neighbours, then the label of that label; the number of steps
    goes with the logarithm of the longest path.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, n = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        of = lambda node, label: by_size(labels.select(F.col("node").alias(node), F.col("label").alias(label)), n)
        near = both.join(of("b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = near.join(of("node", "old"), "node").select("node", "old", F.least("old", "m").alias("via"))
        after = written(step.join(of("via", "next"), "via").select("node", "old", F.least("via", "next").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels
