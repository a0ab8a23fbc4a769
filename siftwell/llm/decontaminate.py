"""Benchmark decontamination: which test items does a document contain?

An item is contained when at least threshold of its distinct shingles (five words of lower-cased text) are
among the document's. Candidates come from bottom-k MinHash sketches in partitions by the item's size: of an item of q
shingles, of which need = ceil(threshold q) must be found, the sketch is the k = q - need + 1 smallest hashes, so a
document that contains the item has one of these at least and none is missed. Partition c holds the items of 2**c to 2**(c + 1) - 1
shingles, and has a bound of its own: its largest sketch hash. In a partition only a document's hashes up to the bound are looked
for, which of a long document are a fixed share, about that of the sketch in the item. Candidates
are verified by counting the shared shingles exactly.

Words are runs of [0-9a-z_] and of characters beyond ASCII. A text of one to four words has one shingle of
all its words, so such an item is found in documents of just these words and not in longer ones, where so few words also stand by
chance; a text without words, or a null, contains nothing and is contained nowhere. Repeated rows of
documents give repeated rows; rows of items with equal id and text count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from siftwell.llm import _kernel as K
from siftwell.llm._arrow import with_columns
from siftwell.llm._store import doc_key, written

WORDS = 5
THRESHOLD = 0.8
#: Shingles of items (16 bytes each with their owners) that may be broadcast.
BROADCAST_SHINGLES = 2_000_000
#: Bits of the filter of sketch hashes that tasks get for a larger suite (16 MB, whatever its size).
FILTER_BITS = 27


def text_shingles(texts: pa.Array, size: int = WORDS) -> Iterator[tuple[K.Slice, np.ndarray, np.ndarray]]:
    """For each slice of texts in lower case: hashes of all shingles and the text of each."""
    for s in K.slices(texts):
        w = K.find_words(s, K.ALNUM)
        yield s, *K.shingles(K.word_hashes(s, w), w.first, size)


def need(q: np.ndarray | int, threshold: float):
    """How many of q shingles must be found."""
    return np.ceil(np.asarray(q) * threshold - 1e-9).astype(np.int64)


def item_shingles(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item_id, shingles): sorted distinct hashes, packed, of each item that has words."""
    rows = items.select(F.col(item_id).alias("item_id"), F.lower(F.col(text)).alias("text")).distinct()

    def run(texts):
        out = []
        for s, h, doc in text_shingles(texts, size):
            cut = np.searchsorted(doc, np.arange(s.n + 1))
            out += [np.unique(h[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
        return [pa.array(out, pa.binary())]

    return with_columns(rows, "text", [StructField("shingles", BinaryType())], run, ["item_id"]).where(F.length("shingles") > 0)


def partition_of(q: np.ndarray) -> np.ndarray:
    """The size partition of items of q shingles: the exponent of the power of two below."""
    return np.frexp(np.asarray(q, np.float64))[1].astype(np.int64) - 1


def sketch_of(shingles: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest of an item's sorted hashes, one of which every document that contains it has."""
    return shingles[: len(shingles) - int(need(len(shingles), threshold)) + 1]


@dataclass
class Sketches:
    """The sketches of one partition, sorted, and the largest hash in them."""

    hashes: np.ndarray

    def __post_init__(self):
        self.bound = self.hashes[-1]
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def among(self, h: np.ndarray) -> np.ndarray:
        """Positions in h of hashes that are in a sketch."""
        at = np.flatnonzero(h <= self.bound)
        at = at[self.may[(h[at] >> np.uint64(48)).astype(np.int64)]]
        return at[_among(h[at], self.hashes)]


@dataclass
class Suite:
    """Items as arrays: ids, shingles of all items by hash with their owners, and the sketches of each size partition."""

    ids: list
    need: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    owners: np.ndarray
    partitions: list[Sketches]

    @classmethod
    def of(cls, ids: list, packed: list[bytes], threshold: float) -> Suite:
        sets = [np.frombuffer(p, np.uint64) for p in packed]
        sizes = np.array([len(x) for x in sets], np.int64)
        h = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(h, kind="stable")
        of = partition_of(sizes)
        parts = [Sketches(np.unique(np.concatenate([sketch_of(sets[i], threshold) for i in np.flatnonzero(of == c)]))) for c in np.unique(of)]
        return cls(ids, need(sizes, threshold), sizes, h[order], owner[order], parts)

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Positions in h of hashes that are in a sketch of any partition."""
        return np.concatenate([*[p.among(h) for p in self.partitions], np.zeros(0, np.int64)])

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that a document with the distinct shingles h contains, and how many shingles each shares."""
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        items, count = np.unique(self.owners[at], return_counts=True)
        enough = count >= self.need[items]
        return items[enough], count[enough]


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def contained(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = WORDS,
    threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment) of every document and item it contains.

    A suite of at most broadcast_shingles shingles goes to every task, and documents aren't shuffled. Of a
    larger one tasks get the partitions' bounds and a filter of fixed size; the hashes that pass are joined with the sketches, and
    a document's text meets its candidates' shingles once.
    """
    own = written(item_shingles(items, item_id, text, size), "items")
    total = own.agg(F.sum(F.length("shingles") / 8)).first()[0] or 0
    pairs = _by_broadcast(docs, own, doc_id, text, size, threshold) if total <= broadcast_shingles else _by_join(docs, own, doc_id, text, size, threshold)
    return pairs.withColumn("containment", F.col("shared") / F.col("n_shingles"))


def _pair_schema(docs: DataFrame, doc_id: str, own: DataFrame) -> StructType:
    return StructType([
        StructField("doc_id", docs.schema[doc_id].dataType), StructField("item_id", own.schema["item_id"].dataType),
        StructField("shared", LongType()), StructField("n_shingles", LongType()),
    ])


def _by_broadcast(docs: DataFrame, own: DataFrame, doc_id: str, text: str, size: int, threshold: float) -> DataFrame:
    t = own.toArrow().sort_by("shingles")
    suite = docs.sparkSession.sparkContext.broadcast(Suite.of(t["item_id"].to_pylist(), t["shingles"].to_pylist(), threshold))
    schema = _pair_schema(docs, doc_id, own)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"))
    arrow = to_arrow_schema(schema)

    def run(batches):
        s = suite.value
        for b in batches:
            out: list[list] = [[], [], [], []]
            base, ids = 0, b.column(0)
            for part, h, doc in text_shingles(b.column(1), size):
                found = np.unique(doc[s.candidates(h)])
                cut = np.searchsorted(doc, np.stack([found, found + 1])).T.tolist()
                for d, (lo, hi) in zip(found.tolist(), cut):
                    items, count = s.shared(np.unique(h[lo:hi]))
                    out[0] += [ids[base + d].as_py()] * len(items)
                    out[1] += [s.ids[i] for i in items]
                    out[2] += count.tolist()
                    out[3] += s.sizes[items].tolist()
                base += part.n
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _filter_place(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each hash in the filter."""
    place = h >> np.uint64(64 - FILTER_BITS)
    return (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))


def _by_join(docs: DataFrame, own: DataFrame, doc_id: str, text: str, size: int, threshold: float) -> DataFrame:
    items = own.select("item_id", "shingles", F.xxhash64("item_id", "shingles").alias("item"), (F.length("shingles") / 8).cast("long").alias("n_shingles"))
    of_hash = StructType([StructField(c, LongType()) for c in ("part", "h", "item", "word", "bit")])

    def sketches(batches):
        for b in batches:
            sets = [np.frombuffer(p, np.uint64) for p in b.column(1).to_pylist()]
            heads = [sketch_of(x, threshold) for x in sets]
            n = [len(x) for x in heads]
            h = np.concatenate([*heads, np.zeros(0, np.uint64)])
            word, bit = _filter_place(h)
            part = np.repeat(partition_of(np.array([len(x) for x in sets])), n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, h.view(np.int64), np.repeat(b.column(0).to_numpy(), n), word, bit.view(np.int64))], names=of_hash.names)

    sketch = written(items.select("item", "shingles").mapInArrow(sketches, of_hash), "sketches")
    # At most 64 partitions; unsigned order of hashes is that of the sign-flipped number.
    tops = sketch.groupBy("part").agg(F.max(F.expr("h ^ (-9223372036854775807 - 1)")).alias("top")).collect()
    bounds = [(r.part, np.uint64(r.top + (1 << 63))) for r in tops]
    # At most 2**(FILTER_BITS - 6) words of 64 bits.
    words = sketch.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text")).select("doc_id", "text", *doc_key())
    of_doc = StructType([StructField(c, LongType()) for c in ("part", "h", "_k1", "_k2")])

    def document_hashes(batches):
        for b in batches:
            base, k1, k2 = 0, b.column(0).to_numpy(), b.column(1).to_numpy()
            for s, h, doc in text_shingles(b.column(2), size):
                word, bit = _filter_place(h)
                may = (shared.value[word] & bit) != 0
                for part, bound in bounds:
                    at = np.flatnonzero(may & (h <= bound))
                    row = base + doc[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), pa.array(h[at].view(np.int64)), pa.array(k1[row]), pa.array(k2[row])], names=of_doc.names)
                base += s.n

    hashes = keyed.select("_k1", "_k2", "text").mapInArrow(document_hashes, of_doc)
    pairs = written(hashes.join(sketch.select("part", "h", "item"), ["part", "h"]).select("_k1", "_k2", "item").distinct(), "candidates")
    texts = keyed.join(pairs.select("_k1", "_k2").distinct(), ["_k1", "_k2"])
    none = lambda f: F.lit(None).cast(own.schema[f].dataType).alias(f)
    turns = texts.select("_k1", "_k2", F.lit(0).alias("turn"), "doc_id", "text", none("item_id"), none("shingles"))
    turns = turns.unionByName(pairs.join(items, "item").select("_k1", "_k2", F.lit(1).alias("turn"), F.lit(None).cast(docs.schema[doc_id].dataType).alias("doc_id"), F.lit(None).cast("string").alias("text"), "item_id", "shingles"))
    schema = _pair_schema(docs, doc_id, own)
    arrow = to_arrow_schema(schema)

    def verify(batches):
        """Of each document its rows, all alike, come first and then the items, packed."""
        now, mine, copies, own_id = None, np.zeros(0, np.uint64), 0, None
        for b in batches:
            out: list[list] = [[], [], [], []]
            keys, (turn, ids, items_, packed) = zip(*[b.column(i).to_pylist() for i in (0, 1)]), (b.column(i).to_pylist() for i in (2, 3, 5, 6))
            for key, t, d, i, p, h in zip(keys, turn, ids, items_, packed, _distinct_sets(b.column(4), size)):
                if t == 0:
                    now, mine, copies, own_id = key, h, copies + 1 if key == now else 1, d
                    continue
                x = np.frombuffer(p, np.uint64)
                n = int(_among(x, mine).sum())
                if n >= need(len(x), threshold):
                    for column, v in zip(out, (own_id, i, n, len(x))):
                        column += [v] * copies
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    return turns.repartition("_k1", "_k2").sortWithinPartitions("_k1", "_k2", "turn").mapInArrow(verify, schema)


def _distinct_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for s, h, doc in text_shingles(texts, size):
        cut = np.searchsorted(doc, np.arange(s.n + 1))
        yield from (np.unique(h[a:b]) for a, b in zip(cut, cut[1:]))
