"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts, of up to ORDER bytes. A byte that follows a context c times, in t occurrences of the context with d
different next bytes, has the probability c / (t + d) there; what is left (d, and bytes that were pruned) is the probability of escaping to the
context with one byte less, down to 1/256 for each byte. The code length of a text under a language is the sum of -log2 of its bytes' probabilities,
exactly; the language of the shortest code is predicted (ties: the first in order), with its share among the languages if all were
equally likely before as the score. A text stands behind ORDER zero bytes. Statistics are frozen: reading a text changes nothing.

Fitting counts all training texts: tasks count the (ORDER + 1)-byte runs of their texts by language, Spark adds them up, and the shorter
contexts' counts are sums of these. The tree's branches are as deep as their counts allow: a run stays if it makes up more than 1 / NODES
of its language's bytes, where NODES (a parameter) over the number of languages is the most that one may have in each order, at any size of input. So
the model that goes to every task has at most (ORDER + 1) * NODES runs of 16 bytes, whatever the corpus.

A null text and one without letters gets the language `und` and a score of 0, as does every text if nothing was learned. Rows with a null lang teach nothing; a null id is not held
out. Repeated rows count repeatedly. Columns that have the names of new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from siftwell.llm import _kernel as K
from siftwell.llm._arrow import with_columns
from siftwell.llm._store import written

#: Bytes of the longest context.
ORDER = 3
#: Runs of each order that all languages together may have.
NODES = 2_000_000
#: Bytes of text that are counted at once.
RUN = 4 << 20
UNDETERMINED = "und"


def byte_runs(s: K.Slice) -> np.ndarray:
    """The ORDER + 1 bytes up to each byte of s as a number; before a text stand zeros."""
    n = len(s.data)
    out = s.data.astype(np.uint64)
    # How far each byte is from the start of its text, up to ORDER.
    start = np.zeros(n, bool)
    start[s.offsets[:-1][np.diff(s.offsets) > 0]] = True
    apart = np.ones(n, bool)
    for j in range(1, ORDER + 1):
        apart[j - 1 :] &= ~start[: n - j + 1]
        apart[: j - 1] = False
        own = np.zeros(n, np.uint64)
        own[j:] = s.data[: n - j]
        own[~apart] = 0
        out |= own << K.U64(8 * j)
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.diff(np.append(first, len(keys)))


def count_runs(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, run, n): how often each run of ORDER + 1 bytes ends in the texts of each language."""
    own = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            names, of = langs.dictionary, langs.indices.to_numpy()
            for s in K.slices(b.column("text"), RUN):
                keys = byte_runs(s) | np.repeat(of[s.lo : s.hi].astype(np.uint64), np.diff(s.offsets)) << K.U64(32)
                keys, n = distinct(keys)
                lang = names.take(pa.array((keys >> K.U64(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([lang, pa.array((keys & K.U64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "run", "n"])

    return own.mapInArrow(run, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """Contexts of one language, from none to ORDER bytes: for each order the runs (a context and the byte behind it) that were seen, sorted,
    with the code length of that byte there, and the contexts, sorted, with the code length of an escape."""

    runs: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def lengths(self, runs: np.ndarray) -> np.ndarray:
        """Code lengths in bits of the last byte of each run of ORDER + 1 bytes."""
        out, open_ = np.zeros(len(runs)), np.arange(len(runs))
        for k in range(ORDER, -1, -1):
            own = runs[open_] & K.U64((1 << 8 * (k + 1)) - 1)
            at, found = _lookup(self.runs[k], own)
            out[open_[found]] += self.bits[k][at[found]]
            open_, own = open_[~found], own[~found]
            at, found = _lookup(self.contexts[k], own >> K.U64(8))
            out[open_[found]] += self.escapes[k][at[found]]
            if not len(open_):
                return out
        out[open_] += 8
        return out


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Model:
    """Trees by language; empty if nothing was learned."""

    trees: dict[str, Tree] = field(default_factory=dict)

    def code_lengths(self, texts) -> np.ndarray:
        """(texts, languages): bits of each text under each language, languages in order."""
        out = []
        for s in K.slices(texts, RUN):
            # More texts than 32 bits of a key can tell apart never fit into a slice.
            keys = byte_runs(s) << K.U64(32) | np.repeat(np.arange(s.n, dtype=np.uint64), np.diff(s.offsets))
            keys, n = distinct(keys)
            runs, doc = keys >> K.U64(32), (keys & K.U64(0xFFFFFFFF)).astype(np.int64)
            new = np.ones(len(runs), bool)
            new[1:] = runs[1:] != runs[:-1]
            of = np.cumsum(new) - 1
            out.append(np.stack([np.bincount(doc, tree.lengths(runs[new])[of] * n, s.n) for tree in self.trees.values()], axis=1))
        return np.concatenate(out) if out else np.zeros((0, len(self.trees)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", nodes: int = NODES) -> Model:
    """A model of all texts of docs by their languages."""
    full = written(count_runs(docs, text, lang), "byte_runs")
    sizes = {r.lang: r.n for r in full.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return Model()
    # Runs of more than this share of a language's bytes are fewer than nodes / languages.
    share = len(sizes) / nodes
    least = F.broadcast(docs.sparkSession.createDataFrame([(x, n * share) for x, n in sizes.items()], "lang string, least double"))
    orders = []
    for k in range(ORDER + 1):
        runs = full.groupBy("lang", (F.col("run") % (1 << 8 * (k + 1))).alias("run")).agg(F.sum("n").alias("n")) if k < ORDER else full
        of = runs.groupBy("lang", F.shiftright("run", 8).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d"))
        kept = lambda df, n: df.join(least, "lang").where(F.col(n) > F.col("least")).drop("least").toArrow()
        orders.append((kept(runs, "n"), kept(of, "t")))
    return Model({x: _tree(x, orders) for x in sorted(sizes)})


def _tree(lang: str, orders: list[tuple[pa.Table, pa.Table]]) -> Tree:
    tree = Tree([], [], [], [])
    for kept, of in orders:
        own = lambda t, *names: [c.to_numpy() for c in t.filter(pc.equal(t["lang"], lang)).select(names).sort_by(names[0]).columns]
        runs, n = own(kept, "run", "n")
        contexts, t, d = own(of, "context", "t", "d")
        at = np.searchsorted(contexts, runs >> 8)
        tree.runs.append(runs.astype(np.uint64))
        tree.bits.append(np.log2((t + d)[at] / n))
        tree.contexts.append(contexts.astype(np.uint64))
        tree.escapes.append(np.log2((t + d) / (t + d - np.bincount(at, n, len(contexts)))))
    return tree


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (its columns keep, or all) with lang_pred and score. No shuffle."""
    names = [*model.trees]
    shared = df.sparkSession.sparkContext.broadcast(model)
    lettered = "_lettered"
    while lettered.lower() in {c.lower() for c in df.columns}:
        lettered = f"_{lettered}"
    own = df.withColumn(lettered, F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`")))
    keep = df.columns if keep is None else keep

    def run(texts):
        none = texts.is_null().to_numpy(zero_copy_only=False)
        if not names:
            return [pa.array([UNDETERMINED] * len(none)), pa.array(np.zeros(len(none)))]
        bits = shared.value.code_lengths(texts)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        return [pa.array(np.where(none, UNDETERMINED, np.array(names, object)[best]), pa.string()), pa.array(np.where(none, 0.0, score))]

    return with_columns(own, lettered, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], run, keep)
