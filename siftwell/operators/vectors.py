"""Exact nearest vectors: blocks of queries meet blocks of vectors, and a block gives its own best rows only."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.graph import components
from siftwell.operators.lexical import top
from siftwell.operators.vector_index import centres, runs, units, usable
from siftwell.store import written

BLOCK = 4096
QUERY_BLOCK = 256
#: Scores that a task holds at once: 2 MB.
SCORES = 1 << 18
#: Bytes of blocks that are sent to every task.
BROADCAST_BYTES = 64 << 20

#: Larger is nearer.
METRICS = {
    "cosine": lambda q, v: (q @ v.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :], 1e-300),
    "dot": lambda q, v: q @ v.T,
    "l2": lambda q, v: np.stack([-np.sqrt(((v - x) ** 2).sum(axis=1)) for x in q]),
    "l1": lambda q, v: np.stack([-np.abs(v - x).sum(axis=1) for x in q]),
}


def _blocks(df: DataFrame, vec_id: str, embedding: str, size: int, prefix: str) -> DataFrame:
    """(ids, data): many vectors a row. Rows with a null id or vector are left out."""
    own = df.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], [f"{prefix}i", f"{prefix}v"])

    return own.mapInArrow(run, f"{prefix}i binary, {prefix}v binary")


def _every_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each block of left with each block of right; right goes to every task if it is small, else blocks meet by the right one's number."""
    right = written(right, "blocks")
    of = right.agg(F.sum(sum((F.length(c) for c in right.columns), F.lit(0))).alias("bytes"), F.count("*").alias("n")).first()
    if (of.bytes or 0) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right))
    # A table of block numbers, a row for megabytes, meets the left blocks; then the right blocks join by number.
    numbered = written(right.withColumn("_b", F.monotonically_increasing_id()), "numbered_blocks")
    return left.join(F.broadcast(numbered.select("_b"))).join(numbered.hint("merge"), "_b").drop("_b")


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, the largest first; ties go to the least id, and what is minus infinite or no number is left out."""
    s[np.isnan(s)] = -np.inf
    bar = np.partition(s, -k, axis=1)[:, -k :][:, :1] if s.shape[1] > k else -np.inf
    row, column = np.nonzero((s >= bar) & (s > -np.inf))
    order = np.lexsort((ids[column], -s[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vec_id: str = "vec_id", embedding: str = "embedding", itself: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of vectors to each of a stated set of queries.

    The query set meets all vectors in blocks, and every pair of blocks passes on k rows a query at most; a task holds SCORES of a pair at once.
    itself: whether a vector may be found by the query of its own id. All vectors have one length.
    """
    measure = METRICS[metric]
    pairs = _every_pair(_blocks(vectors, vec_id, embedding, BLOCK, "v"), _blocks(queries, vec_id, embedding, QUERY_BLOCK, "q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*b.columns):
                # Views of the batch: blocks are megabytes, and copies of a batch's would add up.
                ids, v, qids, q = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, ("<i8", "<f8") * 2))
                v, q = v.reshape(len(ids), -1), q.reshape(len(qids), -1)
                step = max(1, SCORES // len(ids))
                for lo in range(0, len(qids), step):
                    own = qids[lo : lo + step]
                    s = np.round(measure(q[lo : lo + step], v), 6)
                    if not itself:
                        s[own[:, None] == ids[None, :]] = -np.inf
                    at, i = _best(s, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(ids[i]), pa.array(s[at, i])], ["query_id", "vec_id", "score"])

    found = pairs.select("vi", "vv", "qi", "qv").mapInArrow(run, "query_id long, vec_id long, score double")
    return top(found, k, "vec_id")


def _stars(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(least id, other ids) of each set of rows and columns that true cells connect."""
    free = linked.any(axis=1)
    for r in np.flatnonzero(free):
        if not free[r]:
            continue
        own, found, front = np.zeros(len(rows), bool), np.zeros(len(columns), bool), np.array([r])
        while len(front):
            own[front], free[front] = True, False
            new = linked[front].any(axis=0) & ~found
            found |= new
            front = np.flatnonzero(linked[:, new].any(axis=1) & ~own)
        ids = np.unique(np.concatenate([rows[own], columns[found]]))
        yield ids[:1], ids[1:]


def alike_classes(
    vectors: DataFrame, least: float, metric: str = "cosine", vec_id: str = "vec_id", embedding: str = "embedding", rows: int = 1024, columns: int = BLOCK, report: dict | None = None
) -> DataFrame:
    """(vec_id, class_id, n_links): vectors that any chain of scores of least or more connects have the same class, the least id in it.

    Equal vectors are one, with a number of copies, so a large group of copies costs a comparison a block. For the cosine, vectors lie in rings of like angles
    to the centres of cells (see vector_index), in blocks of at most the lesser of rows and columns; blocks whose rings can't hold a pair of the score
    by the triangle inequality of angles never meet, and none is left out that could. How many that spares depends on least and on the vectors: with least near 1 and clustered vectors
    nearly all, of random ones with a low least none, and then work goes with the square of the number of different vectors. report gets the numbers of pairs of vectors
    there are and that were compared. A pair of blocks passes on, of each set of vectors that it connects, a row a vector and its number of links. Vectors without a link are left out.
    """
    measure, size = METRICS[metric], min(rows, columns)
    every = written(usable(vectors, vec_id, embedding).select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")), "vectors")
    # 128 bits name equal vectors.
    one = written(every.groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("v").alias("v")), "different")
    blocks, pairs = _rings(one, least, metric, size)
    of = blocks.agg(F.sum(F.length("vectors")).alias("bytes")).first()
    small = (of.bytes or 0) <= BROADCAST_BYTES
    side = lambda p: blocks.select(F.col("block").alias(p), F.col("ids").alias(f"{p}_ids"), F.col("copies").alias(f"{p}_n"), F.col("vectors").alias(f"{p}_v"))
    # A task for each 20 million comparisons: a pair is two short numbers, but a product of blocks.
    compared = pairs.agg(F.sum("compared")).first()[0] or 0
    met = pairs.repartition(max(1, min(compared // 20_000_000, 50_000)), "a", "b").join(F.broadcast(side("a")) if small else side("a").hint("merge"), "a").join(F.broadcast(side("b")) if small else side("b").hint("merge"), "b")
    if report is not None:
        n = one.count()
        report |= {"pairs": n * (n - 1) // 2, "compared": compared}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, ai, an, av, bi, bn, bv in zip(*b.columns):
                ids, copies = [np.frombuffer(x.as_py(), "<i8") for x in (ai, bi)], [np.frombuffer(x.as_py(), "<i8") for x in (an, bn)]
                left, right = (np.frombuffer(x.as_py(), "<f8").reshape(len(i), -1) for x, i in zip((av, bv), ids))
                linked = np.round(measure(left, right), 6) >= least
                out = [(ids[0], linked @ copies[1])]
                if a.as_py() == z.as_py():
                    # A vector is alike to its copies if it is to itself, which a zero vector is not.
                    itself = np.diag(linked)
                    out = [(ids[0], linked @ copies[1] - itself)]
                    linked = np.triu(linked, 1)
                else:
                    out.append((ids[1], copies[0] @ linked))
                for first, others in _stars(linked, *ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(first, len(others))), pa.array(others), pa.array(np.zeros(len(others), np.int64))], ["a", "b", "n"])
                for own, n in out:
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(own[some]), pa.array(n[some].astype(np.int64))], ["a", "b", "n"])

    found = written(met.select("a", "b", "a_ids", "a_n", "a_v", "b_ids", "b_n", "b_v").mapInArrow(run, "a long, b long, n long"), "alike")
    classes = components(found.where("a <> b").select("a", "b").distinct())
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    # A vector whose only links are its copies is its own class.
    named = links.join(classes, "node", "left").select(F.col("node").alias("first"), F.coalesce("label", "node").alias("class_id"), "n_links")
    of_each = one.select("h", "g", F.col("id").alias("first")).join(named, "first")
    return every.select("id", "h", "g").join(of_each, ["h", "g"]).select(F.col("id").alias("vec_id"), "class_id", "n_links")


def _rings(one: DataFrame, least: float, metric: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, ids, copies, vectors) of at most size vectors, and the pairs (a, b, compared) of them that have to meet, each once."""
    prune = metric == "cosine" and least > 0
    c = centres(one, cells=256, sample=10_000) if prune else np.zeros((0, 0))
    prune = prune and len(c) > 1
    shared = one.sparkSession.sparkContext.broadcast(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) if prune else c)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                if prune:
                    cosine = units(b.column("v")) @ shared.value.T
                    cell = cosine.argmax(axis=1).astype(np.int32)
                    angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), b.column("id"), b.column("copies"), b.column("v")], ["cell", "angle", "id", "copies", "v"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, b in runs(batches, size):
            ids, copies, angle = (b.column(x).to_numpy() for x in ("id", "copies", "angle"))
            data = b.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
            blobs = [pa.array([x], pa.binary()) for x in (ids.astype("<i8").tobytes(), copies.astype("<i8").tobytes(), data)]
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([angle.min()]), pa.array([angle.max()]), pa.array([len(ids)]), *blobs], ["cell", "lo", "hi", "n", "ids", "copies", "vectors"])

    placed = one.mapInArrow(place, "cell int, angle double, id long, copies long, v array<double>")
    placed = written(placed, "placed").repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle")
    cut = placed.mapInArrow(block, "cell int, lo double, hi double, n long, ids binary, copies binary, vectors binary")
    blocks = written(cut.withColumn("block", F.monotonically_increasing_id()), "rings")
    rings = blocks.select("block", "cell", "lo", "hi", "n")
    # The most that a cosine, rounded to six places, may be off.
    wide = math.acos(max(-1.0, min(1.0, least - 1e-6))) + 1e-6 if prune else math.pi
    cells = rings.groupBy("cell").agg(F.max("hi").alias("hi")).collect()  # at most a row a cell
    names = np.array([r.cell for r in cells], np.int64)
    reach, own = np.array([r.hi for r in cells]), shared.value[names] if prune else np.zeros((len(cells), 1))
    between = np.arccos(np.clip(own @ own.T, -1, 1)) if prune else np.zeros((len(cells), len(cells)))
    x, y = np.nonzero(between - reach[:, None] - reach[None, :] <= wide)
    meets = one.sparkSession.createDataFrame(pd.DataFrame({"cell": names[x], "other": names[y], "between": between[x, y]}), "cell int, other int, between double")
    other = rings.toDF("b", "other", "lo2", "hi2", "n2")
    near = F.greatest(F.col("between") - F.col("hi") - F.col("hi2"), F.col("lo") - F.col("between") - F.col("hi2"), F.col("lo2") - F.col("between") - F.col("hi"))
    pairs = rings.join(meets, "cell").join(other, "other").where((F.col("block") <= F.col("b")) & (near <= wide))
    compared = F.when(F.col("block") == F.col("b"), F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("n2"))
    return blocks, written(pairs.select(F.col("block").alias("a"), "b", compared.alias("compared")), "ring_pairs")


@lru_cache(1 << 15)
def _hashed(token: str, dim: int) -> int:
    """A token's place in a vector of dim if its sign is plus, else the place's complement."""
    import xxhash

    h = xxhash.xxh64_intdigest(token.encode())
    return h % dim if h >> 63 else ~(h % dim)


def hashed_embeddings(rows: list[list[str]], dim: int = 64) -> np.ndarray:
    """hashed_embedding of each row's tokens."""
    hashed = np.fromiter(map(_hashed, chain.from_iterable(rows), repeat(dim)), np.int64)
    plus = hashed >= 0
    cell = np.repeat(np.arange(len(rows)), [len(x) for x in rows]) * dim + np.where(plus, hashed, ~hashed)
    out = np.bincount(cell, np.where(plus, 1.0, -1.0), len(rows) * dim).astype(float).reshape(len(rows), dim)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0)


def hashed_embedding(tokens: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic embedding of a bag of words: signed counts by hash, of unit length."""
    return hashed_embeddings([tokens], dim)[0]
