"""A stored BM25 index: segments of posting blocks, tombstones, and one small table of versions that says which of them count.

A segment holds documents in blocks of BLOCK of like lengths, and three tables: `docs` (tokens of each document with its block and slot), `ids` (a row a block: the
documents and lengths of its slots) and `postings` (a row a token and block: slots and counts, the largest count and the least length), the latter dealt by the hash of token and
range of blocks and sorted, so a token that all documents have is many rows in many files. Inserts add a segment, deletes a table of tombstones that carries what statistics have to forget, and merging
makes one segment of what is left, from tokens that are stored. Each change ends by committing a version; what a crash leaves before that is never read.

A search is exact. What a block can add to a query is bounded by its tokens' largest counts and least lengths under the statistics of now. The most promising blocks of each
query are scored first; the k-th best score so far is a bar, and of the other blocks only those are read whose bound reaches the bar of a query. Scoring a block is a product
of the queries' weights and its documents' parts, and a block passes on k rows a query.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.graph import by_size, stored
from siftwell.operators.lexical import OKAPI, QUERY_CELLS, Model, top
from siftwell.store import Versions, written

#: Documents of a block.
BLOCK = 128
#: Blocks of each query that are scored first.
FIRST = 4
_STATE = "kind string, name string, n_docs long, length long"


@dataclass
class Report:
    """Posting blocks that a search had for its tokens, and those whose postings it read."""

    blocks: int = 0
    read: int = 0


class LexicalIndex:
    """An index below path, which the driver and all executors share.

    Ids may repeat (each row is a document of its own) or be null (counted in the statistics, never found); a null text has no tokens.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/state", _STATE)

    # What the state says

    def _state(self) -> tuple[int, list]:
        version = self.versions.latest()
        return version, self.versions.read(version).collect()  # a row a segment or table of tombstones

    def _commit(self, version: int, rows: list) -> int:
        return self.versions.commit(self.spark.createDataFrame([tuple(r) for r in rows], _STATE).coalesce(1), version)

    def _tables(self, rows: list, kind: str, table: str) -> DataFrame | None:
        names = [r.name for r in rows if r.kind == kind]
        out = None
        for name in names:
            own = self.spark.read.parquet(f"{self.path}/{name}/{table}")
            own = own.withColumn("segment", F.lit(name)) if kind == "segment" else own
            out = own if out is None else out.unionByName(own)
        return out

    def _live(self, rows: list) -> DataFrame | None:
        docs, gone = self._tables(rows, "segment", "docs"), self._tables(rows, "gone", "rows")
        if docs is None or gone is None:
            return docs
        return docs.join(gone.select("segment", "block", "slot"), ["segment", "block", "slot"], "left_anti")

    # Changes

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> int:
        """Add documents; returns the new version."""
        tokens = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), T.words(F.col(f"`{text}`")).alias("tokens"))
        version, rows = self._state()
        return self._commit(version, [*rows, self._segment(tokens)])

    def upsert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> int:
        """Documents replace those of the same ids, in one version."""
        own = written(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), T.words(F.col(f"`{text}`")).alias("tokens")), "upsert")
        version, rows = self._state()
        gone = self._tombstones(rows, own.select("doc_id"))
        return self._commit(version, [*rows, *([gone] if gone else []), self._segment(own)])

    def delete(self, ids: DataFrame) -> int:
        """Forget the documents of ids (doc_id); unknown ones are ignored."""
        version, rows = self._state()
        gone = self._tombstones(rows, ids.select("doc_id"))
        return self._commit(version, [*rows, gone]) if gone else version

    def merge(self) -> int:
        """One segment of all live documents, without tombstones."""
        version, rows = self._state()
        live = self._live(rows)
        return version if live is None else self._commit(version, [self._segment(live.select("doc_id", "tokens"))])

    def _segment(self, tokens: DataFrame) -> tuple:
        """Write a segment of (doc_id, tokens); its row of the state."""
        name = f"segment-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        # Documents stay in their partitions, where those of like lengths follow each other and make up blocks.
        ordered = tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens").sortWithinPartitions("dl").withColumn("row", F.monotonically_increasing_id())
        placed = ordered.select("doc_id", "dl", "tokens", F.floor(F.col("row") / BLOCK).alias("block"), (F.col("row") % BLOCK).cast("int").alias("slot"))
        placed.write.option("compression", "zstd").parquet(f"{at}/docs")
        docs = self.spark.read.parquet(f"{at}/docs")
        docs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slot", "doc_id", "dl"))).alias("rows")).write.option("compression", "zstd").parquet(f"{at}/ids")
        # Counted where documents are; only posting blocks are shuffled, those of a token to several tasks if they are many.
        of = docs.select("block", "slot", "dl", "tokens").mapInArrow(_postings, "block long, token string, slots array<int>, tfs array<int>, top_tf int, least_dl long, n int")
        of.repartition("token", F.floor(F.col("block") / 64)).sortWithinPartitions("token", "block").write.option("compression", "zstd").parquet(f"{at}/postings")
        total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return "segment", name, total.n, total.length

    def _tombstones(self, rows: list, ids: DataFrame) -> tuple | None:
        live = self._live(rows)
        if live is None:
            return None
        name = f"gone-{uuid.uuid4().hex}"
        live.join(ids.distinct(), "doc_id", "left_semi").select("segment", "block", "slot", "dl", F.array_distinct("tokens").alias("terms")).write.option("compression", "zstd").parquet(f"{self.path}/{name}/rows")
        total = self.spark.read.parquet(f"{self.path}/{name}/rows").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return ("gone", name, total.n, total.length) if total.n else None

    # Searching

    def search(self, query_terms: DataFrame, k: int, model: Model = OKAPI, report: Report | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents of each query (query_id, token, qtf), as lexical.ranked gives them over the live documents.

        A query set beyond QUERY_CELLS is searched in batches. Jobs run while the result is made.
        """
        _, state = self._state()
        wanted = written(query_terms.select("query_id", "token", "qtf"), "query_terms")
        size = wanted.agg(F.count_distinct("query_id").alias("q"), F.count_distinct("token").alias("t")).first()
        batches = max(1, math.ceil(size.q * size.t / QUERY_CELLS))
        out = None
        for i in range(batches):
            own = wanted if batches == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == i)
            found = self._searched(state, own, k, model, report)
            out = found if out is None else out.unionByName(found)
        return out

    def _searched(self, state: list, wanted: DataFrame, k: int, model: Model, report: Report | None) -> DataFrame:
        spark, rows = self.spark, wanted.collect()
        queries, tokens = sorted({r.query_id for r in rows}), sorted({r.token for r in rows})
        postings, ids, gone = self._tables(state, "segment", "postings"), self._tables(state, "segment", "ids"), self._tables(state, "gone", "rows")
        kind = wanted.schema["query_id"].dataType.simpleString()
        id_kind = "long" if ids is None else ids.schema["rows"].dataType.elementType["doc_id"].dataType.simpleString()
        if not tokens or postings is None:
            return spark.createDataFrame([], f"query_id {kind}, doc_id {id_kind}, score double, rank int")
        sign = {"segment": 1, "gone": -1}
        n = sum(sign[r.kind] * r.n_docs for r in state)
        mean = sum(sign[r.kind] * r.length for r in state) / n if n else 0.0
        named = F.broadcast(spark.createDataFrame(list(enumerate(tokens)), "t int, token string"))  # under QUERY_CELLS
        heads, n_heads = stored(postings.select("segment", "block", "token", "n", "top_tf", "least_dl").join(named, "token").drop("token"), "heads")
        df = dict.fromkeys(range(len(tokens)), 0) | {r.t: r.n for r in heads.groupBy("t").agg(F.sum("n").alias("n")).collect()}
        if gone is not None:
            for r in gone.select(F.explode("terms").alias("token")).join(named, "token").groupBy("t").agg(F.count("*").alias("n")).collect():
                df[r.t] -= r.n
        found = np.array([df[t] for t in range(len(tokens))], float)
        weight, place, at = np.zeros((len(queries), len(tokens))), {q: i for i, q in enumerate(queries)}, {t: i for i, t in enumerate(tokens)}
        for r in rows:
            weight[place[r.query_id], at[r.token]] = r.qtf
        weight *= np.where(found > 0, model.idf(n, np.maximum(found, 1)), 0)
        shared = spark.sparkContext.broadcast(weight)

        bounds = written(heads.repartition("segment", "block").sortWithinPartitions("segment", "block").mapInArrow(_bounds(shared, model, mean), "segment string, block long, n int, bounds binary"), "bounds")
        best = bounds.mapInArrow(_promising(FIRST), "q int, segment string, block long, bound double")
        order = Window.partitionBy("q").orderBy(F.col("bound").desc(), "segment", "block")
        first = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST).select("segment", "block").distinct()
        first, n_first = stored(first, "first_blocks")
        start = written(self._scored(postings, ids, gone, named, first, n_first, shared, model, mean, k, id_kind), "first_scores")
        bar = np.full(len(queries), -np.inf)
        for r in start.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("score"), False), k, 1).alias("s")).collect():  # a number a query
            bar[r.q] = r.s[0] if r.s else -np.inf
        bars = spark.sparkContext.broadcast(bar)
        rest, n_rest = stored(bounds.join(by_size(first, n_first), ["segment", "block"], "left_anti").mapInArrow(_open(bars), "segment string, block long"), "open_blocks")
        more = self._scored(postings, ids, gone, named, rest, n_rest, shared, model, mean, k, id_kind)
        if report is not None:
            report.blocks += n_heads
            both, n_both = stored(first.unionByName(rest), "read_blocks")
            report.read += heads.join(by_size(both, n_both), ["segment", "block"], "left_semi").count()
        ranked = top(start.unionByName(more), k, group="q")
        names = F.broadcast(spark.createDataFrame(list(enumerate(queries)), f"q int, query_id {kind}"))
        return written(ranked, "searched").join(names, "q").select("query_id", "doc_id", "score", "rank")

    def _scored(self, postings: DataFrame, ids: DataFrame, gone: DataFrame | None, named: DataFrame, blocks: DataFrame, n: int, shared, model: Model, mean: float, k: int, id_kind: str) -> DataFrame:
        """(q, doc_id, score) of the k best live documents of each of these blocks."""
        own = postings.join(named, "token").join(by_size(blocks, n), ["segment", "block"]).select("segment", "block", "t", "slots", "tfs")
        names = ids.join(by_size(blocks, n), ["segment", "block"])
        none = F.array().cast("array<int>")
        if gone is not None:
            names = names.join(gone.groupBy("segment", "block").agg(F.collect_list("slot").alias("gone")), ["segment", "block"], "left")
        names = names.select("segment", "block", F.lit(-1).alias("t"), F.coalesce(F.col("gone") if gone is not None else none, none).alias("slots"), none.alias("tfs"), F.col("rows.doc_id").alias("ids"), F.col("rows.dl").alias("dls"))
        rows = names.unionByName(own, allowMissingColumns=True)
        ordered = rows.repartition("segment", "block").sortWithinPartitions("segment", "block", "t")
        return ordered.mapInArrow(_scores(shared, model, mean, k), f"q int, doc_id {id_kind}, score double")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posting blocks of each run of documents of a block; a block that was read in two pieces gives a token two rows, with different slots."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            own = b.slice(lo, BLOCK)
            block, slot, dl = (own.column(c).to_numpy().astype(np.int64) for c in ("block", "slot", "dl"))
            words = own.column("tokens").flatten().dictionary_encode()
            if not len(words):
                continue
            names = words.dictionary
            row = np.repeat(np.arange(own.num_rows), np.diff(own.column("tokens").offsets.to_numpy()))
            first = block - block.min()
            # In the order of blocks, tokens and rows.
            key, tf = np.unique((first[row] * len(names) + words.indices.to_numpy()) * BLOCK + row, return_counts=True)
            of, at = key // BLOCK, key % BLOCK
            start = np.flatnonzero(np.diff(of, prepend=-1))
            offsets = pa.array(np.append(start, len(of)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (slot[at], tf)]
            numbers = [np.maximum.reduceat(tf, start).astype(np.int32), np.minimum.reduceat(dl[at], start), np.diff(np.append(start, len(of))).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[start] // len(names) + block.min()), names.take(pa.array(of[start] % len(names))), *lists, *map(pa.array, numbers)],
                ["block", "token", "slots", "tfs", "top_tf", "least_dl", "n"],
            )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each (segment, block); rows come sorted by these."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        segment, block = b.column(0).to_pylist(), b.column(1).to_numpy()
        cuts = [0, *[i for i in range(1, b.num_rows) if block[i] != block[i - 1] or segment[i] != segment[i - 1]], b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            own = (segment[lo], int(block[lo]))
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _bounds(shared, model: Model, mean: float):
    """For each block the most that a document of it can score for each query, as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for (segment, block), t in _groups(batches):
            at = t["t"].to_numpy()
            part = model.part(t["top_tf"].to_numpy().astype(float), t["least_dl"].to_numpy().astype(float), mean or 1.0)
            bound = weight[:, at] @ part
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([block]), pa.array([len(at)], pa.int32()), pa.array([bound.astype("<f8").tobytes()], pa.binary())], ["segment", "block", "n", "bounds"])

    return run


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _promising(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bound = _numbers(b.column("bounds"))
                m = min(first, len(bound))
                rows = np.argpartition(-bound, m - 1, axis=0)[:m].T.ravel()
                q = np.repeat(np.arange(bound.shape[1]), m)
                keep = bound[rows, q] > 0
                rows, q = rows[keep], q[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), b.column("segment").take(pa.array(rows)), b.column("block").take(pa.array(rows)), pa.array(bound[rows, q])], ["q", "segment", "block", "bound"])

    return run


def _open(bars):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bound = _numbers(b.column("bounds"))
                # Scores are rounded to six places.
                reach = ((bound > 0) & (bound >= bars.value - 2e-6)).any(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("segment").filter(pa.array(reach)), b.column("block").filter(pa.array(reach))], ["segment", "block"])

    return run


def _scores(shared, model: Model, mean: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for _, t in _groups(batches):
            t = t.combine_chunks()
            head = t.slice(0, 1).to_pylist()[0]  # the documents of the block; sorted first, as its t is -1
            ids, dl = head["ids"], np.array(head["dls"], float)
            live = np.array([i is not None for i in ids])
            live[head["slots"]] = False
            own = t.slice(1)
            at, slots, tfs = own["t"].to_numpy(), own["slots"].combine_chunks(), own["tfs"].combine_chunks()
            tf = np.zeros((len(ids), len(at)))
            column = np.repeat(np.arange(len(at)), np.diff(slots.offsets.to_numpy()))
            tf[slots.flatten().to_numpy(), column] = tfs.flatten().to_numpy()
            score = np.round(weight[:, at] @ np.where(tf > 0, model.part(tf, dl[:, None], mean or 1.0), 0).T, 6)
            score[:, ~live] = 0
            # Ranks of the ids for ties; the places of null ids are never used.
            order = np.zeros(len(ids), np.int64)
            named = [i for i in range(len(ids)) if ids[i] is not None]
            order[sorted(named, key=ids.__getitem__)] = np.arange(len(named))
            q, found = [], []
            for j, row in enumerate(score):
                some = np.flatnonzero(row > 0)
                if len(some) > k:
                    some = some[np.lexsort((order[some], -row[some]))[:k]]
                q.append(np.full(len(some), j, np.int32))
                found.append(some)
            q, found = np.concatenate(q), np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(q), t["ids"].chunk(0)[0].values.take(pa.array(found)), pa.array(score[q, found])], ["q", "doc_id", "score"])

    return run
