"""BM25. A stated query set goes to every task, as a table of cells if it is small and else as its terms' lists of queries, and documents are
scored where they are; bm25() joins an inverted index made by grouping instead."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.store import written

#: Cells (queries times their distinct terms) of a query set that goes to every task: 64 MB.
QUERY_CELLS = 8_000_000
#: Pairs of a query and a term of a query set that goes to every task without cells: 48 MB.
QUERY_TERMS = 4_000_000
#: Cells (documents times terms) that a task scores at once.
CELLS = 2_000_000
#: A term's share of documents times its share of queries from which a product of cells costs less than its list of queries.
DENSE = 0.0075
#: Cells (queries times columns) of such products: 64 MB.
COLUMN_CELLS = 8_000_000
#: Texts that a task takes out of a batch at once.
SLICE = 256
#: Rows of a query and a term that bm25() sends to every task: some 20 MB.
QUERY_ROWS = 200_000
#: Pairs of a document and a query that a task of bm25() scores.
PAIRS = 500_000


def postings(docs: DataFrame, doc_id: str = "doc_id", tokens: Column | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, token, tf, dl): a row per document and token, of wanted (token) only where it is given; documents without tokens have none."""
    own = docs.select(F.col(doc_id).alias("doc_id"), (T.words("text") if tokens is None else tokens).alias("tokens"))
    # Of an exploded column Spark filters out empty ones first, and would cut every text into words once more for that.
    each = own.select("doc_id", F.size("tokens").alias("dl"), F.inline(F.arrays_zip(F.col("tokens").alias("token"))))
    return (each if wanted is None else each.join(wanted, "token", "left_semi")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def statistics(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """One row: number of documents and their mean length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(T.n_words("text") if tokens is None else F.size(tokens)).alias("avgdl"))


def terms(queries: DataFrame, query_id: str, text: str = "text") -> DataFrame:
    """(query_id, token, qtf) of all words of each query; repeated words count repeatedly."""
    own = queries.select(F.col(query_id).alias("query_id"), F.explode(T.words(text)).alias("token"))
    return own.groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


@dataclass(frozen=True)
class Model:
    """BM25; delta over 0 gives the lower-bounded form (BM25+) with its own idf."""

    k1: float = 1.2
    b: float = 0.75
    delta: float = 0.0

    def idf(self, n: float, df: np.ndarray) -> np.ndarray:
        return np.log((n + 1) / df) if self.delta > 0 else np.log(1 + (n - df + 0.5) / (df + 0.5))

    def part(self, tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
        return self.delta + tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / mean))


OKAPI, PLUS = Model(), Model(1.5, 0.75, 0.5)
_FIND = re.compile(r"\w+").findall


def _counts(docs: DataFrame, shared, size: int) -> tuple[int, float, np.ndarray]:
    """Number of documents, mean length and, of each of size terms (term: number), the number of documents that have it; the driver gets two numbers a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df, lookup = 0, 0, np.zeros(size, np.int64), shared.value
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                for t in b.column(0).slice(lo, SLICE).to_pylist():
                    words = _FIND((t or "").lower())
                    n, length = n + 1, length + len(words)
                    df[[j for j in map(lookup.get, set(words)) if j is not None]] += 1
        some = np.flatnonzero(df)
        numbers = [np.append(-1, some).astype(np.int32), np.append(n, df[some]), np.append(length, np.zeros(len(some), np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], ["t", "n", "length"])

    rows = docs.select("text").mapInArrow(run, "t int, n long, length long").groupBy("t").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).toArrow()
    t, n, length = (rows[c].to_numpy() for c in ("t", "n", "length"))
    df = np.zeros(size)
    df[t[t >= 0]] = n[t >= 0]
    total = int(n[t < 0].sum())
    return total, (float(length[t < 0].sum()) / total if total else 0.0), df


def ranked(docs: DataFrame, query_terms: DataFrame, k: int, models: tuple[Model, ...] = (OKAPI,), doc_id: str = "doc_id", zeros: bool = False, among: Column | None = None) -> list[DataFrame]:
    """For each model (query_id, doc_id, score, rank) of the k best documents of each query; ties go to the least id.

    Documents are read twice, once for their counts and once for their scores, which of a batch are products of the queries'
    weights and the documents' parts for all models at once; a batch passes on k rows a query. With zeros, documents without any term of
    the query come last, with a score of 0. With among only documents for which it is true are ranked, by the counts of all. A query set beyond QUERY_CELLS goes
    to tasks as its terms' lists of queries, in parts of some QUERY_TERMS, one after the other.
    """
    wanted = written(query_terms, "query_terms")
    size = wanted.agg(F.count_distinct("query_id").alias("q"), F.count_distinct("token").alias("t")).first()
    if size.q * size.t > QUERY_CELLS:
        if zeros and size.q > 1:
            # Every document is in every result, so halves of the query set are scored one after the other.
            ids = sorted(r.query_id for r in wanted.select("query_id").distinct().collect())
            halves = [wanted.where(F.col("query_id") < ids[size.q // 2]), wanted.where(F.col("query_id") >= ids[size.q // 2])]
            return [a.unionByName(b) for a, b in zip(*[ranked(docs, h, k, models, doc_id, True, among) for h in halves])]
    if size.q * size.t > QUERY_CELLS and not zeros:
        parts = max(1, -(-wanted.count() // QUERY_TERMS))
        out = [_ranked_by_lists(docs, wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), k, models, doc_id, among) for i in range(parts)]
        return [reduce(DataFrame.unionByName, of) for of in zip(*out)]
    rows = wanted.collect()
    queries, tokens = sorted({r.query_id for r in rows}), sorted({r.token for r in rows})
    at = {t: i for i, t in enumerate(tokens)}
    place = {q: i for i, q in enumerate(queries)}
    context = docs.sparkSession.sparkContext
    place_of = context.broadcast(at)
    n, mean, found = _counts(docs, place_of, len(tokens))
    weight = np.zeros((len(queries), len(tokens)))
    for r in rows:
        weight[place[r.query_id], at[r.token]] = r.qtf
    weights = context.broadcast([weight * np.where(found > 0, m.idf(n, np.maximum(found, 1)), 0) for m in models])
    kind = docs.schema[doc_id].dataType.simpleString()
    query_kind = wanted.schema["query_id"].dataType.simpleString()
    step = max(1, CELLS // max(len(tokens), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = place_of.value
        for b in batches:
            for lo in range(0, b.num_rows, step):
                ids, texts = b.column(0).slice(lo, step), b.column(1).slice(lo, step).to_pylist()
                dl, known = np.zeros(len(texts)), []
                for i, t in enumerate(texts):
                    words = _FIND((t or "").lower())
                    dl[i] = len(words)
                    known.append(np.unique(np.array([j for j in map(lookup.get, words) if j is not None], np.int64), return_counts=True))
                doc = np.repeat(np.arange(len(texts)), [len(x) for x, _ in known])
                term, tf = np.concatenate([x for x, _ in known]), np.concatenate([x for _, x in known]).astype(float)
                # Parts are made of the terms that texts have; one table of all cells is held, for each model in turn.
                cells = np.zeros((len(texts), len(tokens)))
                own, place_in, scores = [], [], []
                order = np.argsort(np.argsort(np.array(ids.to_pylist(), object), kind="stable"), kind="stable") if len(ids) else np.zeros(0, int)
                for m, w in enumerate(weights.value):
                    cells[doc, term] = models[m].part(tf, dl[doc], mean or 1.0)
                    score = np.round(w @ cells.T, 6)
                    for q, row in enumerate(score):
                        some = np.arange(len(row)) if zeros else np.flatnonzero(row > 0)
                        if len(some) > k:
                            some = some[row[some] >= np.partition(row[some], -k)[-k]]
                            some = some[np.lexsort((order[some], -row[some]))[:k]]
                        own.append(np.stack([np.full(len(some), m), np.full(len(some), q)]))
                        place_in.append(some)
                        scores.append(row[some])
                if own:
                    models_, queries_ = np.concatenate(own, axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(models_), pa.array(queries_), ids.take(pa.array(np.concatenate(place_in))), pa.array(np.concatenate(scores))], ["model", "q", "doc_id", "score"])

    found_rows = docs.where(F.col(doc_id).isNotNull() & (F.lit(True) if among is None else among)).select(F.col(doc_id).alias("doc_id"), "text").mapInArrow(run, f"model int, q int, doc_id {kind}, score double")
    best = Window.partitionBy("model", "q").orderBy(F.col("score").desc(), F.col("doc_id"))
    best = written(found_rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
    # A row for each query of the bounded set.
    names = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(queries)), f"q int, query_id {query_kind}"))
    return [best.where(F.col("model") == m).join(names, "q").select("query_id", "doc_id", "score", "rank") for m in range(len(models))]


class _Best:
    """The k best (query, id, score) so far; ties go to the least id. bar is a score that a query's further documents have to reach."""

    def __init__(self, queries: int, k: int, ids: pa.DataType):
        self.k, self.bar = k, np.full(queries, 1e-9)
        self.q, self.ids, self.score, self.new = np.zeros(0, np.int32), pa.array([], ids), np.zeros(0), []
        self.room, self.held = max(200_000, k * queries), 0

    def add(self, ids: pa.Array, score: np.ndarray) -> None:
        """score: (documents, queries), not rounded yet."""
        near = score >= self.bar - 1e-6
        if len(score) > self.k and np.count_nonzero(near) > self.k * len(self.bar):
            # Most documents count until bars have risen.
            self.bar = np.maximum(self.bar, np.round(np.partition(score, -self.k, axis=0)[-self.k], 6))
            near = score >= self.bar - 1e-6
        d, q = np.divmod(np.flatnonzero(near), score.shape[1])
        some = np.round(score[d, q], 6)
        own = some >= self.bar[q]
        d, q = d[own], q[own]
        self.new.append((q.astype(np.int32), ids.take(pa.array(d)), some[own]))
        self.held += len(d)
        if self.held > self.room:
            self.cut()

    def cut(self) -> None:
        q, score = (np.concatenate([own, *[x[i] for x in self.new]]) for own, i in ((self.q, 0), (self.score, 2)))
        ids = pa.concat_arrays([self.ids, *[x[1] for x in self.new]])
        key = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else pc.rank(ids).to_numpy()
        order = np.lexsort((key, -score, q))
        q = q[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        last = order[at == self.k - 1]
        keep = order[at < self.k]
        self.bar[q[at == self.k - 1]] = score[last]
        self.q, self.score, self.ids, self.new, self.held = q[at < self.k], score[keep], ids.take(pa.array(keep)), [], 0


def _ranked_by_lists(docs: DataFrame, wanted: DataFrame, k: int, models: tuple[Model, ...], doc_id: str, among: Column | None) -> list[DataFrame]:
    """ranked() of a query set as each term's list of queries; terms that many documents and many queries have are cells of a product. A task passes on k rows a query."""
    context = docs.sparkSession.sparkContext
    rows = wanted.select("query_id", "token", F.col("qtf").cast("double").alias("qtf")).toArrow().combine_chunks()  # QUERY_TERMS at most
    queries, tokens = (rows[c].combine_chunks().dictionary_encode("encode") for c in ("query_id", "token"))
    q, t = (x.indices.to_numpy() for x in (queries, tokens))
    queries, size = queries.dictionary, len(tokens.dictionary)
    place_of = context.broadcast({w: i for i, w in enumerate(tokens.dictionary.to_pylist())})
    n, mean, df = _counts(docs, place_of, size)
    idf = [np.where(df > 0, m.idf(n, np.maximum(df, 1)), 0) for m in models]
    qf = np.bincount(t, minlength=size)
    cost = df / max(n, 1) * qf / max(len(queries), 1)
    cells = np.argsort(-cost, kind="stable")[: COLUMN_CELLS // max(len(queries), 1)]
    cells = cells[cost[cells] >= DENSE]
    column = np.full(size, -1)
    column[cells] = np.arange(len(cells))
    dense = np.zeros((len(cells), len(queries)))
    inside = column[t] >= 0
    qtf = rows["qtf"].to_numpy()
    dense[column[t[inside]], q[inside]] = qtf[inside]
    order = np.flatnonzero(~inside)
    order = order[np.argsort(t[order], kind="stable")]
    start = np.searchsorted(t[order], np.arange(size + 1))
    shared = context.broadcast((idf, column, dense, start, q[order].astype(np.int32), qtf[order], queries))
    kind, query_kind = docs.schema[doc_id].dataType.simpleString(), wanted.schema["query_id"].dataType.simpleString()
    step = max(1, min(SLICE, CELLS // max(len(queries), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, (idf, column, dense, start, lists, qtf, queries) = place_of.value, shared.value
        many, best = len(queries), None
        for b in batches:
            best = best or [_Best(many, k, b.column(0).type) for _ in models]
            for lo in range(0, b.num_rows, step):
                texts, known, dl = b.column(1).slice(lo, step).to_pylist(), [], []
                for text in texts:
                    words = _FIND((text or "").lower())
                    dl.append(len(words))
                    known.append(np.unique(np.array([j for j in map(lookup.get, words) if j is not None], np.int64), return_counts=True))
                doc = np.repeat(np.arange(len(texts)), [len(x) for x, _ in known])
                term, tf = np.concatenate([x for x, _ in known]), np.concatenate([x for _, x in known]).astype(float)
                long = np.array(dl, float)[doc]
                own, each = column[term] >= 0, start[term + 1] - start[term]
                upto = np.cumsum(np.bincount(doc, each, len(texts))).astype(np.int64)
                for m, model in enumerate(models):
                    part = model.part(tf, long, mean or 1.0) * idf[m][term]
                    x = np.zeros((len(texts), len(dense)))
                    x[doc[own], column[term[own]]] = part[own]
                    score, first = x @ dense, 0
                    while first < len(texts):
                        # Some CELLS of documents' terms and their queries at once.
                        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + CELLS // 2, "right")))
                        a, z = np.searchsorted(doc, (first, end))
                        of = np.repeat(np.arange(a, z), each[a:z])
                        place = np.arange(len(of)) + np.repeat(start[term[a:z]] - np.cumsum(each[a:z]) + each[a:z], each[a:z])
                        score[first:end] += np.bincount((doc[of] - first) * many + lists[place], part[of] * qtf[place], (end - first) * many).reshape(-1, many)
                        first = end
                    best[m].add(b.column(0).slice(lo, step), score)
        for m, found in enumerate(best or []):
            found.cut()
            for lo in range(0, len(found.q), 100_000):
                part = slice(lo, lo + 100_000)
                own = pa.array(found.q[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m, np.int32)), queries.take(own), found.ids[part], pa.array(found.score[part])], ["model", "query_id", "doc_id", "score"])

    named = docs.where(F.col(doc_id).isNotNull() & (F.lit(True) if among is None else among)).select(F.col(doc_id).alias("doc_id"), "text")
    order_of = Window.partitionBy("model", "query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    found_rows = named.mapInArrow(run, f"model int, query_id {query_kind}, doc_id {kind}, score double")
    ranked_rows = written(found_rows.withColumn("rank", F.row_number().over(order_of)).where(F.col("rank") <= k), "ranked")
    return [ranked_rows.where(F.col("model") == m).drop("model") for m in range(len(models))]


def bm25(docs: DataFrame, query_terms: DataFrame, k1: float = 1.2, b: float = 0.75, delta: float = 0.0, doc_id: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, score) of documents with at least one term of the query.

    delta over 0 gives the lower-bounded form (BM25+) with its own idf. Texts are read once for an index of the queries' terms, which is written. Its postings
    are dealt by document, and terms' weights go to every task if there are QUERY_ROWS at most, so that a document's scores are summed where its postings are and top() passes on k rows
    a query and task; else both are joined by term, and parts of scores are shuffled.
    """
    asked = written(query_terms.select("query_id", "token", "qtf"), "query_terms")
    index = written(postings(docs, doc_id, wanted=asked.select("token").distinct()), "postings")
    of = statistics(docs).first()
    n, df, tf, mean = F.lit(float(of.n_docs)), F.col("df"), F.col("tf"), of.avgdl or 1.0
    idf = F.log((n + 1) / df) if delta > 0 else F.log(1 + (n - df + 0.5) / (df + 0.5))
    weights = asked.join(index.groupBy("token").agg(F.count("*").alias("df")), "token").select("query_id", "token", (F.col("qtf") * idf).alias("weight"))
    own = index.select("doc_id", "token", (delta + tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / mean))).alias("part"))
    size = asked.agg(F.count("*").alias("rows"), F.count_distinct("query_id").alias("queries")).first()
    if size.rows <= QUERY_ROWS:
        own, weights = own.repartition(max(1, min(of.n_docs * size.queries // PAIRS, 50_000)), "doc_id"), F.broadcast(weights)
    return own.join(weights, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("part")), 6).alias("score"))


def top(scores: DataFrame, k: int, item: str = "doc_id", by: str = "score", group: str = "query_id") -> DataFrame:
    """The k best of each query with their rank; ties go to the least id."""
    order = Window.partitionBy(group).orderBy(F.col(by).desc(), F.col(item).asc())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def expand(query_terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query_terms and those that synonyms (token, synonym) add to them, each once."""
    more = query_terms.join(synonyms, "token").select("query_id", F.col("synonym").alias("token"), "qtf")
    return query_terms.unionByName(more).groupBy("query_id", "token").agg(F.max("qtf").alias("qtf"))
