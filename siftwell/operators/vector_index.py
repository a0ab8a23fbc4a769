"""Cells of vectors: an approximate index for nearest vectors, and bounds that keep blocks apart which can't hold alike vectors.

Cells are the clusters of a bounded sample (k-means of Spark ML); every vector then belongs to the cell whose centre is nearest. The index keeps
each vector as a code: its difference from the centre in bytes, with a scale. A query meets, joined by cell, the codes of its nearest cells only; the best of them by
code are scored again by their vectors. How many cells a query probes is fitted to a wanted recall on a bounded sample of queries.

A join of all vectors needs no recall: cells are cut into rings of like angles to the centre, and by the triangle inequality of angles two rings whose least possible
angle is over the wanted one never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.lexical import top
from siftwell.store import written

#: Vectors that cells are fitted on, at most.
SAMPLE = 50_000
#: Cells, at most; fewer vectors have a square root of their number.
CELLS = 4096
#: Vectors of a block of codes, and queries of a block of queries.
BLOCK, QUERY_BLOCK = 4096, 256
#: Candidates by code that are scored again for each wanted result.
REFINE = 4


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector."""
    own = df.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
    return own.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))


def units(column: pa.Array) -> np.ndarray:
    """The vectors of a list column of one length, at length 1; zero vectors stay."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 17) -> np.ndarray:
    """Centres (cells, dimensions) of unit vectors (id, v), fitted on at most sample of them in the order of a hash of their id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if not n:
        return np.zeros((0, 0))
    k = min(cells or max(1, math.isqrt(n)), CELLS, n, sample)
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(sample)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = chosen.select(array_to_vector(F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v"))).alias("features"))
    if k == 1:
        return np.asarray([chosen.head().v], float)
    model = KMeans(k=k, seed=seed, maxIter=10, initSteps=1).fit(written(unit.repartition(8), "cell_sample"))
    return np.array(model.clusterCenters())


def nearest(u: np.ndarray, c: np.ndarray, many: int = 1) -> np.ndarray:
    """The numbers of the many nearest centres of each row, the nearest first."""
    score = u @ c.T - 0.5 * (c * c).sum(axis=1)
    if many == 1:
        return score.argmax(axis=1)[:, None]
    return np.argsort(-score, axis=1, kind="stable")[:, :many]


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of at most size rows with one value of the first column, by which rows come sorted."""
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
            for at in range(lo, hi, size):
                yield int(key[at]), b.slice(at, min(size, hi - at))


@dataclass
class VectorIndex:
    """Codes by cell, as rows of blocks; centres are at most CELLS vectors. Build it with build()."""

    centres: np.ndarray
    vectors: DataFrame
    cells: DataFrame
    blocks: DataFrame
    probes: int = field(default=1)

    def fit_probes(self, recall: float = 0.95, k: int = 10, queries: int = 100) -> int:
        """Probe as few cells as have this share of the k nearest of a sample of at most queries vectors, found by an exact search."""
        from siftwell.operators.vectors import search

        asked = self.vectors.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(queries)
        asked = written(asked, "probe_queries")
        found = search(self.vectors, asked, k, vec_id="id", embedding="v").select(F.col("vec_id").alias("id"), "query_id")
        rows = found.join(self.cells.select("id", "cell"), "id").select("query_id", "cell").collect()  # k rows a sampled query
        own = {r.id: np.array(r.v) for r in asked.collect()}
        rank = {}
        for q, v in own.items():
            order = nearest((v / max(np.linalg.norm(v), 1e-300))[None], self.centres, len(self.centres))[0]
            rank[q] = np.argsort(order)
        at = np.sort([rank[r.query_id][r.cell] for r in rows])
        self.probes = int(at[min(len(at) - 1, math.ceil(recall * len(at)))]) + 1 if len(at) else 1
        return self.probes

    def search(self, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", probes: int | None = None, itself: bool = False) -> DataFrame:
        """(query_id, vec_id, score, rank): of the vectors in the probed cells the k with the largest cosine, scored exactly; ties go to the least id."""
        probes = min(probes or self.probes, len(self.centres))
        asked = written(usable(queries, vec_id, embedding), "queries")
        if not len(self.centres):
            return asked.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        shared = asked.sparkSession.sparkContext.broadcast(self.centres)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    u = units(b.column("v"))
                    cells = nearest(u, shared.value, probes)
                    rows = np.repeat(np.arange(len(u)), probes)
                    vectors = pa.array([x.astype("<f8").tobytes() for x in u], pa.binary()).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), b.column("id").take(pa.array(rows)), vectors], ["cell", "id", "u"])

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, b in runs(batches, QUERY_BLOCK):
                ids = b.column("id").to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([b"".join(b.column("u").to_pylist())], pa.binary())], ["cell", "qi", "qu"])

        near = asked.mapInArrow(probe, "cell int, id long, u binary")
        asking = near.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").mapInArrow(block, "cell int, qi binary, qu binary")
        most = REFINE * k

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for cell, i, code, qi, qu in zip(*[c.to_pylist() for c in b.columns]):
                    ids, qids = np.frombuffer(i, "<i8"), np.frombuffer(qi, "<i8")
                    c = shared.value[cell]
                    u = np.frombuffer(qu, "<f8").reshape(len(qids), -1)
                    s = (u @ c)[:, None] + u @ decoded(code, len(ids)).T
                    if not itself:
                        s[qids[:, None] == ids[None, :]] = -np.inf
                    m = min(most, len(ids))
                    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    q = np.repeat(np.arange(len(qids)), m)
                    x = s[q, best.ravel()]
                    keep = x > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(qids[q][keep]), pa.array(ids[best.ravel()][keep]), pa.array(x[keep])], ["query_id", "vec_id", "about"])

        met = self.blocks.join(asking, "cell").select("cell", "ids", "codes", "qi", "qu").mapInArrow(score, "query_id long, vec_id long, about double")
        order = Window.partitionBy("query_id").orderBy(F.col("about").desc(), "vec_id")
        some = written(met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("query_id", "vec_id").distinct(), "candidates")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        both = some.join(self.vectors.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        exact = both.select("query_id", "vec_id", F.round(dot("q", "v") / F.greatest(F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")), F.lit(1e-300)), 6).alias("score"))
        return top(exact, k, "vec_id")


def encoded(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences (rows, dimensions) as scales (32-bit) and bytes."""
    scale = (np.abs(r).max(axis=1, initial=0) / 127).astype("<f4")
    return scale, np.round(r / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)


def decoded(codes: bytes, n: int) -> np.ndarray:
    scale = np.frombuffer(codes, "<f4", n)
    return np.frombuffer(codes, np.int8, offset=4 * n).reshape(n, -1) * scale[:, None].astype(np.float64)


def build(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """An index of every vector; rows with a null id or vector are left out. All vectors have one length; repeated ids are rows of their own."""
    own = written(usable(vectors, vec_id, embedding), "vectors")
    c = centres(own, cells, sample)
    shared = own.sparkSession.sparkContext.broadcast(c)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = units(b.column("v"))
                cell = nearest(u, shared.value)[:, 0]
                scale, codes = encoded(u - shared.value[cell])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("id"), pa.array(scale), pa.array([x.tobytes() for x in codes], pa.binary())], ["cell", "id", "scale", "code"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, b in runs(batches, BLOCK):
            ids, scale = b.column("id").to_numpy().astype("<i8"), b.column("scale").to_numpy().astype("<f4")
            codes = scale.tobytes() + b"".join(b.column("code").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([codes], pa.binary())], ["cell", "ids", "codes"])

    coded = written(own.mapInArrow(code, "cell int, id long, scale float, code binary"), "codes")
    # By range, so a cell that holds a third of all vectors is dealt to many tasks.
    blocks = coded.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").mapInArrow(block, "cell int, ids binary, codes binary")
    return VectorIndex(c, own, coded.select("id", "cell"), written(blocks, "code_blocks"))
