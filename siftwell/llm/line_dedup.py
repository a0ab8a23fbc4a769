"""Line dedup over overlapping windows of three lines.

Every run of three lines of a text is hashed (two 64-bit hashes). Of the occurrences of a window in all
texts the first stays, in the order of document id (nulls last) and line; the lines that later ones cover
are removed, overlaps merged. Windows are judged on the input, not on what is left.

Lines end with U+000A. A window of blank lines only is never repeated, and a text of fewer than three lines
has no window. Rows with equal id and text are one document: they are treated alike, and one is no repeat
of the other. A null text stays null; a text all of whose lines go becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm._store import doc_key, written

WINDOW = 3


def _windows(df: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(w1, w2, null_id, id, _k1, _k2, pos): a row for each window; pos counts lines from 1."""
    lines = F.split(F.col(text), "\n", -1)
    rows = df.select(F.col(doc_id).isNull().alias("null_id"), F.col(doc_id).alias("id"), *doc_key(doc_id, text), lines.alias("l")).where(F.size("l") >= size)
    rows = rows.select(
        "null_id", "id", "_k1", "_k2",
        F.transform("l", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("l", lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
        F.transform("l", lambda x: F.trim(x) != "").alias("seen"),
    )
    at = rows.select("null_id", "id", "_k1", "_k2", "a", "b", "seen", F.explode(F.sequence(F.lit(1), F.size("a") - (size - 1))).alias("pos"))
    at = at.where(F.expr(" OR ".join(f"seen[pos + {j - 1}]" for j in range(size))))
    part = lambda c: F.xxhash64(*[F.expr(f"{c}[pos + {j - 1}]") for j in range(size)])
    return at.select(part("a").alias("w1"), part("b").alias("w2"), "null_id", "id", "_k1", "_k2", "pos")


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(_k1, _k2, starts): sorted lines at which a later occurrence of a window starts, for each document that has any.

    Windows are counted with partial aggregates, so a window that a third of the rows share is a row a task.
    Those that occur again are written to the shared folder; the join with them can be split by adaptive
    execution where one is very common.
    """
    order = F.struct("null_id", "id", "_k1", "_k2", "pos")
    first = (
        _windows(df, doc_id, text, size)
        .groupBy("w1", "w2")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"))
        .where("first < last")
        .select("w1", "w2", "first")
    )
    later = _windows(df, doc_id, text, size).join(written(first, "windows").hint("merge"), ["w1", "w2"]).where(order != F.col("first"))
    return later.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def _kept(lines: Column, starts: str, size: int) -> Column:
    """lines without the runs of size lines from each of starts: what lies between them, joined."""

    def between(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(1)).otherwise(F.get(starts, i - 1) + size)
        end = F.when(i == F.size(starts), F.size(lines) + 1).otherwise(F.get(starts, i))
        return F.slice(lines, begin, F.greatest(F.lit(0), end - begin))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), between))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, counts: bool = False) -> DataFrame:
    """df with the repeated lines of its texts removed; with counts, n_lines and n_removed as well (replaced if there)."""
    starts = repeats(df, doc_id, text, size)
    own = [F.col(f"`{c}`") for c in df.columns if not counts or c.lower() not in ("n_lines", "n_removed")]
    row = df.select(F.struct(*own).alias("row"), F.col(doc_id), F.col(text)).select("row", *doc_key(doc_id, text))
    joined = row.join(starts, ["_k1", "_k2"], "left")
    value = F.col(f"row.`{text}`")
    lines = F.split(value, "\n", -1)
    kept = F.when(F.col("starts").isNotNull(), _kept(lines, "starts", size))
    new = joined.select("row", kept.alias("kept"))
    out = [F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(value).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in new.schema["row"].dataType.names]
    if counts:
        n = F.when(value.isNull(), 0).otherwise(F.size(lines)).cast("long")
        out += [n.alias("n_lines"), F.when(F.col("kept").isNotNull(), n - F.size("kept")).otherwise(0).cast("long").alias("n_removed")]
    return new.select(*out)
