"""Near duplicates: DartMinHash signatures, banded joining and exact verification.

A document is the set of shingles (five words) of its lower-cased text. Darts are points of a Poisson field
over each element's weight and a rank; the field is cut into regions, and a hash of the element and the
region says how many darts it holds and where. A document throws the darts of its elements up to the rank at
which about k ln k + 2k of them are expected, and each of the k coordinates keeps the earliest dart that hits it,
so time goes with elements plus darts, not elements times k. The chance that two documents agree at a
coordinate is their (weighted) Jaccard similarity.

Documents with the same set are one node. Nodes that agree in all coordinates of a band share a bucket; of
buckets with the same members one is kept. Pairs in a bucket are compared exactly, in two steps:

1. Every node meets one hub: of its buckets' most connected nodes (those whose buckets have most members) the
   most connected. A copy meets what it was copied from, so a group of near copies, however large, becomes one
   class with a comparison a node.
2. Buckets that still hold several classes, but too many members outside the largest class for one slot, are exchanged for
   finer ones: with the shingles of each node in one order, the rarest first, two nodes of the similarity share one of so many first
   shingles as their sizes fix. Nodes meet by pairs of size classes and such a shingle, so what a template gives to
   all of them brings none together. This loses nothing, whatever the order is.
3. Buckets of several classes are dealt to tasks as blocks: those outside the bucket's largest class
   meet each other and that class. A block compares all pairs by products of its members' shingle
   vectors and passes on only which classes it connects, at most a row a member.

Each text is sent once a block, never once a pair, and no table of pairs is made. Only nodes that share rare shingles with
more than SLOT others of other classes, without being alike, are still sent more than once for each bucket. Two documents of the similarity that share no
bucket are missed, with a chance of 6 in 100,000 at a similarity of 0.8; nothing else is.

Rows with equal id and text are one document. Documents without words, and nulls, are in a class of their own.
With weighted, a shingle weighs what it occurs, in signatures and in the comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from siftwell.llm import _kernel as K
from siftwell.llm._arrow import with_columns
from siftwell.llm._store import doc_key, written
from siftwell.operators.graph import FEW, by_size, components, stored

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares none of the bands with a chance of 6 in 100,000.
BANDS, ROWS = 32, 6
DOCS = 512
#: Members and shingles of a slot; a block is two slots at most.
SLOT, SLOT_SHINGLES = 1024, 1_000_000
#: Texts that one copy of a hub's text is sent for.
PER_HUB = 512
#: Cells of the shingle vectors multiplied at once.
CELLS = 2_000_000
#: Cells of the table that counts shingles of crowded buckets, of one byte each; it only orders shingles, so cells may be shared.
COUNTERS = 1 << 20
_FINE = 6


def _cdf(area: float) -> np.ndarray:
    """P(at most i darts) in a region of this area, as far as it can be told from 1."""
    i = np.arange(1, int(area + 12 * math.sqrt(area)) + 16)
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(area / i))]) - area))


_CDFS: dict[float, np.ndarray] = {}


def _regions() -> Iterator[tuple[float, float]]:
    """Rank intervals: a short one, then doubling."""
    yield 0.0, 2.0**-_FINE
    lo = 2.0**-_FINE
    while True:
        yield lo, 2 * lo
        lo *= 2


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> K.U64(11)).astype(np.float64) * 2.0**-53


def dart_minhash(h: np.ndarray, doc: np.ndarray, n: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n, k) of 64-bit dart names; rows of documents without elements are 0.

    h has the distinct elements of each document, in the order of documents; weight their weights, 1 if not
    given. A weight w takes the cells [0, 1), [1, 2), ... of its axis, of the last only what is below w.
    """
    upto = np.ones(len(h))
    if weight is not None:
        cells = np.ceil(weight).astype(np.int64)
        cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        upto = np.minimum(np.repeat(weight, cells) - cell, 1.0)
        h, doc = K.mix(np.repeat(h, cells) + cell.astype(K.U64) * K.U64(0xA24BAED4963EE407)), np.repeat(doc, cells)
    total = np.bincount(doc, upto, minlength=n)
    out = np.zeros((n, k), np.uint64)
    open_docs = np.flatnonzero(total > 0)
    far = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-9)
    while len(open_docs):
        mine = np.zeros(n, bool)
        mine[open_docs] = True
        at = np.flatnonzero(mine[doc])
        got = _throw(h[at], doc[at], upto[at], far, n, k)
        out[open_docs] = got[open_docs]
        open_docs = open_docs[(got[open_docs] == 0).any(axis=1)]
        far[open_docs] *= 2
    return out


def _throw(h: np.ndarray, doc: np.ndarray, upto: np.ndarray, far: np.ndarray, n: int, k: int) -> np.ndarray:
    keys, names = [np.zeros(0, K.U64)], [np.zeros(0, K.U64)]
    reach = far[doc]
    for r, (lo, hi) in enumerate(_regions()):
        if lo > 0:
            more = reach > lo
            if not more.any():
                break
            h, doc, upto, reach = h[more], doc[more], upto[more], reach[more]
        elif not len(h):
            break
        cdf = _CDFS.get(hi - lo)
        if cdf is None:
            cdf = _CDFS[hi - lo] = _cdf(hi - lo)
        u = _unit(K.mix(h ^ K.U64((0x9E3779B97F4A7C15 * (r + 1)) & K._MASK)))
        own = np.flatnonzero(u >= cdf[0])
        for t in range(len(cdf) - 1):
            if not len(own):
                break
            name = K.mix(h[own] + K.U64((0xC2B2AE3D27D4EB4F * ((r << 20) + t + 1)) & K._MASK))
            place = K.mix(name ^ K.U64(0x165667B19E3779F9))
            hit = _unit(K.mix(place ^ K.U64(0x27D4EB2F165667C5))) < upto[own]
            rank = lo + (hi - lo) * _unit(place)
            coordinate = (name >> K.U64(33)) % K.U64(k)
            # The order of positive floats is that of their bits; the top 40 are a rank to 28 places.
            key = (doc[own].astype(K.U64) * K.U64(k) + coordinate) << K.U64(40) | rank.view(K.U64) >> K.U64(24)
            keys.append(key[hit])
            names.append(name[hit] | K.U64(1))
            own = own[u[own] >= cdf[t + 1]]
    key, name = np.concatenate(keys), np.concatenate(names)
    order = np.argsort(key, kind="stable")
    slot = (key[order] >> K.U64(40)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    out = np.zeros(n * k, np.uint64)
    out[slot[first]] = name[order][first]
    return out.reshape(n, k)


def distinct_shingles(texts, size: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, hashes, text, count) for each run of texts in lower case: the distinct shingles of each text, sorted."""
    for s in K.slices(texts):
        for lo in range(0, s.n, DOCS):
            hi = min(lo + DOCS, s.n)
            at = s.offsets[lo : hi + 1]
            part = K.Slice(0, hi - lo, s.data[at[0] : at[-1]], at - at[0])
            w = K.find_words(part, K.ALNUM)
            h, doc = K.shingles(K.word_hashes(part, w), w.first, size)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            yield part.n, h[first], doc[first], np.diff(np.append(first, len(h)))


def shingle_sets(texts, size: int = WORDS, weighted: bool = False) -> Iterator[np.ndarray]:
    """The distinct shingles of each text in lower case; with weighted, an element for each occurrence."""
    for n, h, doc, count in distinct_shingles(texts, size):
        if weighted:
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            h, doc = K.mix(np.repeat(h, count) + nth.astype(K.U64) * K.U64(K._GOLD)), np.repeat(doc, count)
        yield from np.split(h, np.searchsorted(doc, np.arange(1, n)))


def signatures(df: DataFrame, text: str = "text", size: int = WORDS, weighted: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df with node and node2 (128 bits of the shingle set; null without words), bands (64 bits each) and n_shingles.

    The text is taken as it is; lower it before. With weighted, shingles weigh what they occur.
    """
    k = BANDS * ROWS

    def run(texts):
        node, bands, sizes = [[], []], [], []
        for n, h, doc, count in distinct_shingles(texts, size):
            own = K.mix(h + count.astype(K.U64)) if weighted else K.mix(h)
            full = np.bincount(doc, minlength=n) > 0
            for half, x in zip(node, (own, K.mix(own ^ K.U64(0x5851F42D4C957F2D)))):
                sums = np.zeros(n, K.U64)
                np.add.at(sums, doc, x)
                half.append(pa.array(K.mix(sums).view(np.int64), mask=~full))
            sizes.append(pa.array(np.bincount(doc, count if weighted else None, n).astype(np.int64)))
            d = dart_minhash(h, doc, n, k, count.astype(float) if weighted else None)
            b = np.zeros((n, BANDS), K.U64)
            for j in range(ROWS):
                b = K.mix(b * K.U64(31) + d[:, j::ROWS])
            flat = pa.array(K.mix(b + np.arange(1, BANDS + 1, dtype=K.U64)).view(np.int64).ravel())
            bands.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), flat))
        none = pa.array([], pa.int64())
        return [*[pa.concat_arrays([*x, none]) for x in node], pa.concat_arrays([*bands, pa.array([], pa.list_(pa.int64()))]), pa.concat_arrays([*sizes, none])]

    fields = [StructField("node", LongType()), StructField("node2", LongType()), StructField("bands", ArrayType(LongType())), StructField("n_shingles", LongType())]
    return with_columns(df, text, fields, run, keep)


def shared_buckets(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, id, n_shingles, size) of the members of buckets with several nodes, and how many rows; of buckets with the same members one."""
    members = nodes.select("id", "n_shingles", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "id", "n_shingles")
    of = members.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    shared, n = stored(of.where("size > 1").groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "buckets")
    return stored(members.join(by_size(shared, n), "bucket"), "members")


def hub_pairs(members: DataFrame) -> tuple[DataFrame, int]:
    """(hub, id) of each node that isn't the most connected one of all its buckets, and how many rows."""
    score = members.groupBy("id").agg(F.sum("size").alias("score"))
    ranked = members.select("bucket", "id").join(score.hint("merge"), "id").select("bucket", F.struct("score", "id").alias("r"))
    hubs = ranked.groupBy("bucket").agg(F.max("r").alias("hub"))
    met = members.select("bucket", "id").join(hubs.hint("merge"), "bucket").where("hub.id <> id")
    return stored(met.groupBy("id").agg(F.max("hub").alias("hub")).select("hub.id", F.col("id").alias("other")).toDF("hub", "id"), "pairs")


def _alike(common: np.ndarray, total: np.ndarray, similarity: float) -> np.ndarray:
    """Whether common of a pair's shingles, which sum to total, are the similarity; a little is allowed for rounding."""
    return common >= similarity * (total - common) - 1e-9


def hub_links(pairs: DataFrame, n: int, texts: DataFrame, size: int, similarity: float, weighted: bool) -> DataFrame:
    """(a, b) of the pairs (hub, id) whose sets have the similarity.

    A hub's text is sent once for each PER_HUB of its pairs; tasks hold one hub and a batch of texts.
    """
    many, n_many = stored(pairs.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > PER_HUB), "large_hubs")
    salt = F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("n") / PER_HUB), F.lit(1)))
    salted, n = stored(pairs.join(by_size(many, n_many), "hub", "left").select("hub", "id", salt.alias("salt")), "salted_pairs")
    own = texts.join(by_size(salted, n), "id").select("hub", "salt", F.lit(1).alias("turn"), "id", "text")
    hubs, n_hubs = stored(salted.select(F.col("hub").alias("id"), "salt").distinct(), "hubs")
    rows = own.unionByName(texts.join(by_size(hubs, n_hubs), "id").select(F.col("id").alias("hub"), "salt", F.lit(0).alias("turn"), "id", "text"))

    def run(batches):
        hub, has = None, np.zeros(0, K.U64)
        for t in batches:
            a, turn, b = (t.column(i).to_pylist() for i in (0, 2, 3))
            good = np.zeros(t.num_rows, bool)
            for i, x in enumerate(shingle_sets(t.column(4), size, weighted)):
                if turn[i] == 0:
                    hub, has = a[i], x
                else:
                    if a[i] != hub:
                        raise ValueError(f"texts of hub {a[i]} came without it")
                    good[i] = _alike(_common(has, x), len(has) + len(x), similarity)
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(at), t.column(3).filter(at)], ["a", "b"])

    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "turn").mapInArrow(run, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets shares, by products of 0-1 vectors over the elements that several have."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    who = np.repeat(np.arange(n), [len(x) for x in sets])
    _, at, count = np.unique(np.concatenate([*sets, np.zeros(0, K.U64)]), return_inverse=True, return_counts=True)
    several = count > 1
    place = np.cumsum(several) - 1
    keep = several[at]
    who, column = who[keep], place[at[keep]]
    wide = max(1, CELLS // max(n, 1))
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    for lo in range(0, int(several.sum()), wide):
        a, b = np.searchsorted(column, (lo, lo + wide))
        cells = np.zeros((n, min(wide, int(column[b - 1]) - lo + 1)), np.float32)
        cells[who[a:b], column[a:b] - lo] = 1
        out += cells @ cells.T
    return out


def connected(linked: np.ndarray) -> np.ndarray:
    """The least place that each place is connected with by a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)), label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_links(label: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that connect the same labels as all links between sets of different labels do."""
    size = np.array([len(x) for x in sets])
    if len(sets) == 2:
        good = min(size) >= similarity * max(size) - 1e-9 and _alike(_common(*sets), size.sum(), similarity)
        return (label[:1], label[1:]) if good else (label[:0], label[:0])
    linked = _alike(common_counts(sets), size[:, None] + size[None, :], similarity)
    names, at = np.unique(label, return_inverse=True)
    between = np.zeros((len(names), len(names)), bool)
    x, y = np.nonzero(linked)
    between[at[x], at[y]] = True
    to = connected(between)
    moved = to != np.arange(len(names))
    return names[to[moved]], names[moved]


def _open(members: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, major, outer, inner) of the buckets of several labels, and how many: the largest class, the slots of the other members, and its own.

    A bucket that fits into one slot has one outer slot and no inner one.
    """
    per = members.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("t"))
    top = F.max_by(F.struct("label", "n", "t"), F.struct("n", "label"))
    of = per.groupBy("bucket").agg(top.alias("m"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("t").alias("t")).where("labels > 1")
    slots = lambda n, t: F.greatest(F.ceil(n / SLOT), F.ceil(t / SLOT_SHINGLES), F.lit(1)).cast("int")
    one = (F.col("n") <= SLOT) & (F.col("t") <= SLOT_SHINGLES)
    outer = F.when(one, 1).otherwise(slots(F.col("n") - F.col("m.n"), F.col("t") - F.col("m.t")))
    inner = F.when(one, 0).otherwise(slots(F.col("m.n"), F.col("m.t")))
    return stored(of.select("bucket", F.col("m.label").alias("major"), outer.alias("outer"), inner.alias("inner")), "open_buckets")


def size_classes(most: int) -> np.ndarray:
    """The least size of each class of sizes from 1 to at least most; a class is one size, or spans up to a 16th."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] + max(1, out[-1] // 16))
    return np.array(out, np.int64)


def prefixes(n: int, classes: np.ndarray, similarity: float) -> list[tuple[int, int, int, int]]:
    """(class of the shorter, of the longer, side, length): of a set of n the first elements, in any fixed order, that a partner must share one of.

    Sets of n and m have the similarity only if they share similarity / (1 + similarity) of n + m elements; of two sets that share c,
    the first n - c + 1 and m - c + 1 elements meet. Side is 0 for the shorter's class, 1 for the longer's, 2 where they are the same.
    """
    own = int(np.searchsorted(classes, n, "right")) - 1
    out = []
    for other in range(own, -1, -1):
        if other < own and classes[other + 1] - 1 < similarity * n - 1e-6:
            break
        out.append((other, own, 2 if other == own else 1, max(int(classes[other]), math.ceil(similarity * n - 1e-6))))
    for other in range(own + 1, len(classes)):
        if similarity * classes[other] > n + 1e-6:
            break
        out.append((own, other, 0, int(classes[other])))
    made = []
    for a, b, side, least in out:
        length = n - max(1, math.ceil((similarity * (n + least) - 1e-6) / (1 + similarity))) + 1
        if length > 0:
            made.append((a, b, side, min(length, n)))
    return made


def shingle_counts(texts: DataFrame, size: int, weighted: bool) -> np.ndarray:
    """How often each of COUNTERS cells is hit by the sets of texts, as four times its binary logarithm."""

    def run(batches):
        n = np.zeros(COUNTERS, np.int64)
        for t in batches:
            for x in shingle_sets(t.column(0), size, weighted):
                np.add.at(n, (x % K.U64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], ["cell", "n"])

    t = texts.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.uint8)
    out[t["cell"].to_numpy()] = np.minimum(255, 4 * np.log2(t["n"].to_numpy())).astype(np.uint8) + 1
    return out


def rare_members(texts: DataFrame, counts: np.ndarray, size: int, similarity: float, weighted: bool) -> DataFrame:
    """(bucket, side, id, label, n_shingles) of texts (id, label, text): a row for each first shingle that a partner must share."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        names = ["bucket", "side", "id", "label", "n_shingles"]
        for t in batches:
            own = [np.array(t.column(i).to_pylist(), np.int64) for i in (0, 1)]
            for i, x in enumerate(shingle_sets(t.column(2), size, weighted)):
                x = x[np.lexsort((x, shared.value[(x % K.U64(COUNTERS)).astype(np.int64)]))]
                made = prefixes(len(x), size_classes(2 * len(x)), similarity) if len(x) else []
                if not made:
                    continue
                key = np.concatenate([K.mix(x[:n] ^ K.mix(np.array([(a << 20) + b + 1], K.U64))) for a, b, _, n in made])
                side = np.repeat([m[2] for m in made], [m[3] for m in made])
                rest = [np.full(len(key), v, np.int64) for v in (own[0][i], own[1][i], len(x))]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(side.astype(np.int32)), *map(pa.array, rest)], names)

    return texts.select("id", "label", "text").mapInArrow(run, "bucket long, side int, id long, label long, n_shingles long")


def refined(members: DataFrame, texts: DataFrame, size: int, similarity: float, weighted: bool) -> DataFrame:
    """members (bucket, id, n_shingles, label), the buckets with several slots outside their largest class exchanged for those of rare shingles.

    Links between different labels within a bucket are the same before and after.
    """
    open_, _ = _open(members)
    crowded, n = stored(open_.where("outer > 1").select("bucket"), "crowded")
    if not n:
        return members
    ids, n_ids = stored(members.join(by_size(crowded, n), "bucket").select("id", "label").distinct(), "crowded_nodes")
    own = written(texts.join(by_size(ids, n_ids), "id").select("id", "label", "text"), "crowded_texts")
    rare = rare_members(own, shingle_counts(own, size, weighted), size, similarity, weighted)
    # Most first shingles are a node's own, so little passes the first of these two.
    of = rare.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("side").alias("s"), F.max("side").alias("t"))
    shared, n_shared = stored(of.where("a < b AND (s < t OR s = 2)").select("bucket"), "rare_buckets")
    met = written(rare.join(by_size(shared, n_shared), "bucket").select("bucket", "id", "label", "n_shingles"), "rare_members")
    same = met.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    kept, n_kept = stored(same.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "rare_kept")
    rest = members.join(by_size(crowded, n), "bucket", "left_anti").select("bucket", "id", "label", "n_shingles")
    return written(rest.unionByName(met.join(by_size(kept, n_kept), "bucket").select("bucket", "id", "label", "n_shingles")), "refined")


def _blocks(members: DataFrame) -> DataFrame:
    """(bucket, i, j, id, label): the members of each block of the buckets with several labels.

    Slots hold members outside the bucket's largest class first, then that class; block (i, j) is slots i and j, where i is
    one of the first kind. A bucket that fits into one slot is block (0, 0).
    """
    open_, n_open = _open(members)
    named = members.join(by_size(open_, n_open), "bucket")
    h, first, all_ = F.xxhash64("id"), (F.col("inner") == 0) | (F.col("label") != F.col("major")), F.col("outer") + F.col("inner")
    slot = F.when(first, F.pmod(h, F.col("outer"))).otherwise(F.col("outer") + F.pmod(h, F.col("inner"))).cast("int")
    named = named.select("bucket", "id", "label", "outer", all_.alias("all"), slot.alias("slot"))
    others = F.when(F.col("slot") < F.col("outer"), F.sequence(F.lit(0), F.col("all") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") - 1))
    dealt = named.select("bucket", "id", "label", "slot", F.explode(others).alias("o"))
    return dealt.select("bucket", F.least("slot", "o").alias("i"), F.greatest("slot", "o").alias("j"), "id", "label")


def block_links(members: DataFrame, texts: DataFrame, size: int, similarity: float, weighted: bool) -> DataFrame:
    """(a, b): labels that the blocks of members (bucket, id, n_shingles, label) connect."""
    blocks, n = stored(_blocks(members), "blocks")
    rows = texts.join(by_size(blocks, n), "id").select("bucket", "i", "j", "label", "text")

    def run(batches):
        now, label, sets = None, [], []
        out: list[list] = [[], []]

        def judge():
            if len(set(label)) > 1:
                for x, y in zip(out, _block_links(np.array(label), sets, similarity)):
                    x += y.tolist()

        for t in batches:
            keys, own = list(zip(*[t.column(i).to_pylist() for i in range(3)])), t.column(3).to_pylist()
            for k, l, x in zip(keys, own, shingle_sets(t.column(4), size, weighted)):
                if k != now:
                    judge()
                    now, label, sets = k, [], []
                label.append(l)
                sets.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
            out = [[], []]
        judge()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def classes(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, similarity: float = SIMILARITY, weighted: bool = False
) -> DataFrame:
    """(_k1, _k2, doc_id, class): a row for each document; rows with equal id and text are one document.

    class (two numbers) is the same for documents that links of at least similarity connect.
    """
    lowered = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(*doc_key(), "doc_id", F.lower("text").alias("text"))
    rows = written(signatures(lowered, size=size, weighted=weighted, keep=["_k1", "_k2", "doc_id"]), "signatures")
    same = F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n_shingles")
    nodes = rows.where("node IS NOT NULL").groupBy("node", "node2").agg(F.min(F.struct("_k1", "_k2")).alias("k"), *same)
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "node", "node2", "k._k1", "k._k2", "bands", "n_shingles"), "nodes")
    members, n = shared_buckets(nodes)
    labels, n_labels = None, 0
    if n:
        needed, n_needed = stored(nodes.select("id", "_k1", "_k2").join(members.select("id").distinct().hint("merge"), "id"), "needed")
        # The texts of nodes that share a bucket, one of each.
        texts = written(lowered.select("_k1", "_k2", "text").join(by_size(needed, n_needed), ["_k1", "_k2"]).dropDuplicates(["id"]).select("id", "text"), "texts")
        pairs, n = hub_pairs(members)
        labels, n_labels = _merge(None, 0, written(hub_links(pairs, n, texts, size, similarity, weighted), "links"))
        finer = refined(_label(labels, n_labels, members), texts, size, similarity, weighted)
        labels, n_labels = _merge(labels, n_labels, written(block_links(finer, texts, size, similarity, weighted), "links"))
    every = rows.select("_k1", "_k2", "doc_id", "node", "node2")
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b") if b else F.lit(0).cast("long").alias("b"))
    if not n_labels:
        joined, n = stored(nodes.limit(0).select("node", "node2", F.col("id").alias("label")), "named")
    else:
        # Nodes that are alone in their class have its name from their set.
        joined, n = stored(nodes.select("id", "node", "node2").join(by_size(labels, n_labels), "id").select("node", "node2", "label"), "named")
    named = every.join(F.broadcast(joined) if 2 * n <= FEW else joined.hint("merge"), ["node", "node2"], "left")
    names = F.when(F.col("label").isNotNull(), pair("label", None)).when(F.col("node").isNotNull(), pair("node", "node2")).otherwise(pair("_k1", "_k2"))
    return named.select("_k1", "_k2", "doc_id", names.alias("class"))


def _label(labels: DataFrame, n: int, df: DataFrame) -> DataFrame:
    """df with label, that of id, or id where it has none."""
    return df.join(by_size(labels, n), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _merge(labels: DataFrame | None, n: int, edges: DataFrame) -> tuple[DataFrame, int]:
    """(id, label) of the nodes of classes of several after edges between classes, a class's least node with itself; and how many rows."""
    moved = components(edges).withColumnRenamed("node", "id")
    if labels is None:
        return stored(moved, "classes")
    moved, m = stored(moved, "moved")
    to = labels.join(by_size(moved.toDF("label", "to"), m), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return stored(to.unionByName(moved.join(by_size(labels.select("id"), n), "id", "left_anti")), "classes")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size): class_id is the least doc_id of the class (null if none has one)."""
    rows = written(classes(df, doc_id, text, size, similarity), "classes")
    of = written(rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "class_ids")
    return rows.join(of.hint("merge"), "class").select("doc_id", "class_id", "class_size")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df with one document of each class: that of the least id (nulls last), of the least key if ids are equal.

    Of rows with equal id and text one stays, chosen by a hash of its other columns.
    """
    rows = written(classes(df, doc_id, text, size, similarity), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2")
    keep = written(rows.groupBy("class").agg(F.min(order).alias("o")).select("o._k1", "o._k2"), "kept")
    again = rows.groupBy("_k1", "_k2").agg(F.count("*").alias("n")).where("n > 1")
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(doc_id), F.col(text)).select("row", *doc_key(doc_id, text))
    out = own.join(keep.hint("merge"), ["_k1", "_k2"])
    if not again.isEmpty():
        plain = [F.col(f"row.`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        out = out.groupBy("_k1", "_k2").agg(F.min_by("row", F.struct(F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain))).alias("row"))
    return out.select("row.*")
