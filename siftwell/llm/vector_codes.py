"""Vector code compression: product codes over integers, assigned by exponion search.

Each component x becomes floor(256 * x) and each vector is cut into PARTS equal parts, whose positions have a codebook each. In each
round every part goes to the nearest entry of its codebook (squared Euclidean distance in exact integers, ties to the lower index), and each
entry becomes the componentwise floor of the mean of its parts; entries without parts stay.

Exponion search: a part starts at its previous entry, at a distance u. By the triangle inequality no entry further than
2u from that entry can be as near as it, so only the entries within that radius are looked at, in the order of the starting entry's list of
neighbours sorted by distance; the list is taken in rings of doubling size, and after each ring the radius shrinks to u plus the best
distance so far. Radii are rounded up, so ties at the radius are always seen.

A round is one job: tasks assign their vectors and write them with their codes, then sum up parts by entry within the task, and
Spark adds up these partial sums, of which there is a row for each part position and entry. The driver holds codebooks only.

Rows whose vector is null, empty or holds null or non-finite components are dropped. Vectors must all have one length, a multiple of the number of
parts, else ValueError is raised; components so large that squared distances over the whole vector could pass 63 bits (about 10 million
for 64 of them) raise OverflowError, as Spark's own sums do. Repeated ids and equal vectors are rows of their own; among the first ids (nulls
last) ties go to the lesser vector. With fewer rows than entries the codebooks have as many entries as there are rows; without rows nothing is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from siftwell.llm._store import written
from siftwell.operators.graph import by_size, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Entries of the first ring; each further ring doubles what has been looked at.
RING = 8
#: Distances that are whole numbers up to here are exact in floating point.
_EXACT = 1 << 52


@dataclass
class Codebooks:
    """entries[p, e] is entry e of part position p, in integers."""

    entries: np.ndarray

    def __post_init__(self):
        c = self.entries
        d = ((c[:, :, None, :] - c[:, None, :, :]) ** 2).sum(axis=3)
        #: Neighbours of each entry from the nearest on, and their squared distances.
        self.near = np.argsort(d, axis=2, kind="stable")
        self.gap = np.take_along_axis(d, self.near, axis=2)

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors (rows, dimensions) that codes (rows, parts) stand for, on the scale of the components."""
        own = self.entries[np.arange(codes.shape[1]), codes]
        return own.reshape(len(codes), -1) / SCALE


def assign(x: np.ndarray, books: Codebooks, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes (rows, parts), errors of rows, and how many distances were computed; x (rows, dimensions) are integers, start previous codes."""
    parts, k, width = books.entries.shape
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(books.entries).max(initial=0)))
    if (2 * top) ** 2 * parts * width >= 1 << 63:
        raise OverflowError("components are too large for squared distances of 64 bits")
    exact = (2 * top) ** 2 * width < _EXACT
    codes, error, looked = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64), 0
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        code, d, n = _search(own.astype(np.float64) if exact else own, books.entries[p], books.near[p], books.gap[p], start[:, p], exact)
        codes[:, p] = code
        error += d
        looked += n
    return codes, error, looked


def _search(x: np.ndarray, c: np.ndarray, near: np.ndarray, gap: np.ndarray, start: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, int]:
    k = len(c)
    c = c.astype(x.dtype)
    code, best = start.astype(np.int64), ((x - c[start]) ** 2).sum(axis=1).astype(np.int64)
    first = np.sqrt(best.astype(np.float64))
    looked = len(x)
    order = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[order], np.arange(k + 1))
    for a in range(k):
        at = order[cuts[a] : cuts[a + 1]]
        # The first of a's list is a itself, unless an entry before it is equal.
        lo, hi = int(near[a][0] == a), RING
        while len(at) and lo < k:
            # A little is added, so that rounding never leaves an entry out.
            radius = (first[at] + np.sqrt(best[at].astype(np.float64))) * (1 + 1e-9) + 1e-6
            at = at[radius * radius >= gap[a][lo]]
            if not len(at):
                break
            ring = np.sort(near[a][lo:hi])
            d = _distances(x[at], c[ring])
            j = d.argmin(axis=1)
            d = d[np.arange(len(at)), j].astype(np.int64)
            better = (d < best[at]) | ((d == best[at]) & (ring[j] < code[at]))
            best[at[better]], code[at[better]] = d[better], ring[j][better]
            looked += len(at) * len(ring)
            lo, hi = hi, 2 * hi
    return code, best, looked


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole numbers (rows of x, rows of c)."""
    if x.dtype == np.float64:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def kept(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows of df with a vector of finite components; the vector as doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = df.withColumn(vector, F.col(f"`{vector}`").cast("array<double>"))
    return own.where(F.col(f"`{vector}`").isNotNull() & (F.size(f"`{vector}`") > 0) & F.forall(f"`{vector}`", finite))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of a list column (rows, width); lists of another length raise ValueError."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != n * width or (n and (np.diff(column.offsets.to_numpy()) != width).any()):
        raise ValueError(f"vectors must all have {width} components")
    scaled = np.floor(flat * SCALE)
    if n and np.abs(scaled).max(initial=0) >= 1 << 31:
        raise OverflowError("components are too large for squared distances of 64 bits")
    return scaled.astype(np.int64).reshape(n, width)


def first_codebooks(rows: DataFrame, vec_id: str, vector: str, parts: int, entries: int) -> Codebooks | None:
    """Codebooks whose entries are the parts of the first vectors by id; None without rows."""
    head = rows.select(F.col(f"`{vec_id}`").alias("i"), F.col(f"`{vector}`").alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not head:
        return None
    width = len(head[0].v)
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    x = integers(pa.array([r.v for r in head], pa.list_(pa.float64())), width)
    return Codebooks(np.ascontiguousarray(x.reshape(len(head), parts, width // parts).transpose(1, 0, 2)))


def _assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """rows (..., ints, code) with code and error by these codebooks, searched from the codes they have."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    stay = [f for f in rows.schema.fields if f.name not in ("code", "error", "looked")]
    names = [f.name for f in stay]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        parts, _, width = own.entries.shape
        for b in batches:
            if not b.num_rows:
                continue
            x = _ints(b.column("ints"), parts * width)
            code, error, looked = assign(x, own, _bytes(b.column("code"), parts))
            blob = pa.array([r.tobytes() for r in code], pa.binary())
            per = np.zeros(b.num_rows, np.int64)
            per[0] = looked
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], blob, pa.array(error), pa.array(per)], [*names, "code", "error", "looked"])

    return rows.mapInArrow(run, StructType([*stay, StructField("code", BinaryType()), StructField("error", LongType()), StructField("looked", LongType())]))


def _ints(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width).astype(np.int64)


def _bytes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _means(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks with the floored means of the parts that each entry has."""
    parts, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for b in batches:
            x = _ints(b.column("ints"), parts * width).reshape(-1, parts, width)
            at = (_bytes(b.column("code"), parts) + np.arange(parts, dtype=np.int64) * k).ravel()
            count += np.bincount(at, minlength=parts * k)
            # At most 10,000 rows of 32 bits a batch, so floating-point sums are exact.
            for j in range(width):
                total[:, j] += np.bincount(at, x[:, :, j].ravel(), parts * k).astype(np.int64)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["at", "n", "total"])

    partial = rows.select("ints", "code").mapInArrow(run, "at long, n long, total array<long>")
    sums = partial.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(width)]).alias("total"))
    entries = books.entries.reshape(parts * k, width).copy()
    for r in sums.collect():  # one row for each part position and entry
        entries[r.at] = [t // r.n for t in r.total]
    return Codebooks(entries.reshape(parts, k, width))


def _started(rows: DataFrame, vector: str, width: int, parts: int) -> DataFrame:
    """rows with ints (32-bit integers as bytes) for the vector, and codes of 0 to start from."""
    stay = [f for f in rows.schema.fields if f.name != vector]
    names = [f.name for f in stay]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column(vector), width).astype("<i4")
            blobs = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], blobs, pa.array([bytes(parts)] * len(x), pa.binary())], [*names, "ints", "code"])

    return rows.mapInArrow(run, StructType([*stay, StructField("ints", BinaryType()), StructField("code", BinaryType())]))


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error, looked) of each kept vector, and the codebooks; code has a byte a part, looked (the distances that were
    computed) stands on one row of each batch."""
    if not 0 < entries <= 256:
        raise ValueError("codes are bytes")
    rows = kept(df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")), "vector")
    books = first_codebooks(rows, "vec_id", "vector", parts, entries)
    if books is None:
        return df.sparkSession.createDataFrame([], StructType([*rows.schema.fields[:2], StructField("code", BinaryType()), StructField("error", LongType()), StructField("looked", LongType())])), None
    width = parts * books.entries.shape[2]
    state = _started(rows, "vector", width, parts)
    for _ in range(rounds):
        state = written(_assigned(state, books), "codes")
        books = _means(state, books)
    return _assigned(state, books).select("vec_id", "label", "code", "error", "looked"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over equal labels, nulls together.

    A label may have a third of all rows: sums are partial by task, and the join back is by broadcast where labels are
    few, else a sort-merge join whose large partitions Spark splits.
    """
    sums, n = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    none = F.col("label").isNull()
    # A null label becomes a pair of its own, as null keys never meet.
    key = lambda df: df.withColumn("_none", none).withColumn("_label", F.when(none, F.lit(0)).otherwise(F.xxhash64("label")))
    own = key(codes)
    other = key(sums).select("_none", "_label", F.col("label").alias("_same"), "label_error")
    joined = own.join(by_size(other, n), (own["_none"] == other["_none"]) & (own["_label"] == other["_label"]) & own["label"].eqNullSafe(other["_same"]))
    return joined.select(*[own[c] for c in codes.columns], other["label_error"])
