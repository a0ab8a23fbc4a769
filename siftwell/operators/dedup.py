"""Exact and fuzzy duplicates of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.graph import components
from siftwell.store import written

#: Buckets of the counts that rule pairs out.
CHARS, GRAMS = 64, 512
#: Characters of the runs that are counted exactly for pairs that the buckets leave.
RUN = 5
#: Characters of the runs that are counted exactly for the pairs that these leave.
CLOSER = (2, 3)
#: Characters of the runs that are counted exactly for pairs that signatures leave, for longer ones where a text of more than LONG characters is there.
VERIFIED, LONG = ((RUN,), (RUN, 8, 12)), 16_000
#: Pairs of equal characters of two texts that are held at once; texts with more go through SequenceMatcher.
MATCHES = 6_000_000
#: Characters of texts whose runs are held at once.
RUNS_CHARS = 1_000_000
#: Characters of the runs of which signatures are made.
SIGNED_RUN = 6
#: Bits of a text's signature, from the least to the most; between, four to eight for each character.
LEAST_BITS, MOST_BITS = 512, 1 << 20
#: Characters of a block of texts, and bytes of its signatures.
BLOCK_CHARS, BLOCK_BYTES = 8_000_000, 4_000_000
#: Bytes of blocks that are written to one file.
FILE_BYTES = 64_000_000
#: Counts of characters are held up to this, so that 64 differences add up in 16 bits.
MOST_COUNT = 1023
#: Ratios are rounded to six places.
ROUNDED = 5e-7


def fingerprint(text: Column | str = "text") -> Column:
    """sha256 of the text with white space collapsed."""
    return F.sha2(T.single_spaced(text), 256)


def groups(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(fingerprint, first_id, copies): partial aggregates before the shuffle, so a large group costs one row per task."""
    return docs.select(F.col(doc_id).alias("id"), fingerprint().alias("fingerprint")).groupBy("fingerprint").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def exact(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that are the first (least id, nulls last) of their group; of rows of one id in a group any one."""
    own = docs.withColumn("_f", fingerprint())
    order = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("id"))
    first = own.groupBy("_f").agg(F.min(order).alias("_first")).select(F.col("_f").alias("_g"), "_first.id")
    # By fingerprint and id, so a large group meets its first row only.
    kept = own.join(first, (F.col("_f") == F.col("_g")) & F.col(doc_id).eqNullSafe(F.col("id")), "left_semi")
    return kept.dropDuplicates(["_f"]).drop("_f")


def _profile(t: str) -> np.ndarray:
    """Counts of the characters, then of the runs of three, in buckets."""
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    grams = (c[:-2] * 1_000_003 + c[1:-1] * 8191 + c[2:]) * 0x9E3779B1 >> 16
    return np.concatenate([np.bincount(c % CHARS, minlength=CHARS), np.bincount(grams % GRAMS, minlength=GRAMS)]).astype(np.int32)


def _runs(t: str, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of characters, by 64-bit hashes, and their counts."""
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = np.zeros(max(len(c) - run + 1, 0), np.uint64)
    for j in range(run if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : len(c) - run + 1 + j]
    return np.unique(h, return_counts=True)


def _seeds(n: np.ndarray, size: int) -> int:
    """How many characters of a text, of the counts of its different ones and its size, SequenceMatcher's matches can start from where the text is the second one: of 200 characters and more, the popular ones can't."""
    return int(n[n <= size // 100 + 1].sum()) if size >= 200 else size


def _most_apart(far: np.ndarray | float, run: int, seeds: np.ndarray | int) -> np.ndarray | float:
    """How many runs two texts can have apart if at most far characters are deleted or inserted.

    What matches are stretches of which each has a seed, and between two of them some character is deleted or inserted, so there are seeds
    or far + 1 of them at most. Of the runs of a stretch all but run - 1 are in both texts.
    """
    return far + 2 * (run - 1) * np.minimum(far, np.maximum(seeds, 1) - 1)


class _Runs:
    """Counts of the runs of some numbers of characters of texts, made when they are asked for."""

    def __init__(self, sizes: tuple[int, ...] = (RUN,)):
        self.sizes, self.of, self.held = sizes, {}, 0

    def __call__(self, t: str) -> list[tuple[np.ndarray, np.ndarray]]:
        if t not in self.of:
            # Runs take some 16 times their text.
            self.held += len(t)
            if self.held > RUNS_CHARS:
                self.of, self.held = {}, len(t)
            self.of[t] = [_runs(t, r) for r in self.sizes]
        return self.of[t]

    def may(self, a: str, b: str, ratio: float) -> bool:
        """Whether a, after b, could reach the ratio."""
        seeds = _seeds(_places(b)[2], len(b))
        for r, (x, n), (y, m) in zip(self.sizes, self(a), self(b)):
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            apart = n.sum() + m.sum() - 2 * np.minimum(n[i], m[j]).sum()
            if apart > _most_apart((1 - ratio + ROUNDED) * (len(a) + len(b)) + 1e-6, r, seeds):
                return False
        return True


class _SharedRuns:
    """The runs of RUN characters of a block's texts, each with the texts that have it, so one look tells how many a text shares with every other."""

    def __init__(self, texts: list[str], places: np.ndarray):
        own = [_runs(texts[i]) for i in places.tolist()]
        keys, n = (np.concatenate([x[k] for x in own]) if own else np.zeros(0, np.int64) for k in (0, 1))
        text = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x, _ in own])
        order = np.argsort(keys, kind="stable")
        self.keys, self.start = np.unique(keys[order], return_index=True)
        self.end = np.append(self.start[1:], len(keys))
        self.text, self.n, self.size = text[order], n[order].astype(np.int32), len(own)

    def with_all(self, t: str) -> np.ndarray:
        """How many runs, counted as often as both have them, t shares with each text."""
        x, n = _runs(t)
        at = np.searchsorted(self.keys, x)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == x[known]
        at, n = at[known], n[known]
        each = self.end[at] - self.start[at]
        shared, upto, first = np.zeros(self.size), np.cumsum(each), 0
        while first < len(at):
            # A million at once.
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + 1_000_000, "right")))
            many = each[first:last]
            place = np.arange(many.sum()) + np.repeat(self.start[at[first:last]] - np.cumsum(many) + many, many)
            shared += np.bincount(self.text[place], np.minimum(self.n[place], np.repeat(n[first:last], many)), self.size)
            first = last
        return shared


@lru_cache(maxsize=8)
def _long_places(t: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a text's characters, the different ones, their counts, their places one after the other)."""
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    names, n = np.unique(c, return_counts=True)
    return c, names, n, np.argsort(c, kind="stable").astype(np.int32)


_short_places = lru_cache(maxsize=512)(_long_places.__wrapped__)


def _places(t: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (_long_places if len(t) > LONG else _short_places)(t)


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many characters are equal from the start."""
    n, lo, step = min(len(x), len(y)), 0, 16
    while lo < n:
        apart = np.flatnonzero(x[lo : min(lo + step, n)] != y[lo : min(lo + step, n)])
        if len(apart):
            return lo + int(apart[0])
        lo, step = lo + step, 8 * step
    return n


def _common(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(place in a, place in b, length) of all runs of characters that a and b share, of those characters that SequenceMatcher starts from; None if they are too many."""
    (x, *_), (_, names, n, order) = _places(a), _places(b)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    # A text of 200 characters and more has popular ones, which only prolong a match.
    i = np.flatnonzero((names[at] == x) & ((n[at] <= len(b) // 100 + 1) | (len(b) < 200)))
    each = n[at[i]]
    upto = np.cumsum(each)
    if not len(i) or upto[-1] > MATCHES:
        return None if len(i) else (i, i, i)
    key, first = np.empty(upto[-1], np.int64), (np.cumsum(n) - n)[at[i]]
    for lo in range(0, len(i), 4096):
        own, many = i[lo : lo + 4096], each[lo : lo + 4096]
        end = np.cumsum(many)
        place = np.arange(end[-1]) + np.repeat(first[lo : lo + 4096] - end + many, many)
        own = np.repeat(own, many)
        key[upto[lo] - each[lo] :][: end[-1]] = (order[place] - own + len(a)) * (len(a) + 1) + own
    key.sort()
    start = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    length = np.diff(np.append(start, len(key))).astype(np.int32)
    key = key[start]
    i = (key % (len(a) + 1)).astype(np.int32)
    return i, (key // (len(a) + 1) - len(a)).astype(np.int32) + i, length


def _ratio(text: str, earlier: str, ratio: float) -> float:
    """SequenceMatcher's ratio, or 0 where that doesn't reach ratio. Its longest matches are picked from runs that are found at once, and it ends when what is left is too short."""
    m = SequenceMatcher(None, text, "")
    total = len(text) + len(earlier)
    if not text or not earlier or 2 * min(len(text), len(earlier)) / total < ratio - 1e-6:
        return 0.0
    runs = _common(text, earlier)
    if runs is None:
        m.set_seq2(earlier)
        return m.ratio() if m.quick_ratio() >= ratio - 1e-6 else 0.0
    (a, *_), (b, *_), matched, open_ = _places(text), _places(earlier), 0, min(len(text), len(earlier))
    todo = [(0, len(a), 0, len(b), *runs)]
    while todo:
        alo, ahi, blo, bhi, i, j, n = todo.pop()
        lo, hi = np.maximum(np.maximum(alo - i, blo - j), 0), np.minimum(np.minimum(ahi - i, bhi - j), n)
        inside = hi > lo
        i, j, n = (i + lo)[inside], (j + lo)[inside], (hi - lo)[inside]
        x, y, k = alo, blo, 0
        if len(n):
            k = int(n.max())
            most = np.flatnonzero(n == k)
            first = most[np.lexsort((j[most], i[most]))[0]] if len(most) > 1 else most[0]
            x, y = int(i[first]), int(j[first])
        before = _equal(a[alo:x][::-1], b[blo:y][::-1])
        x, y, k = x - before, y - before, k + before
        k += _equal(a[x + k : ahi], b[y + k : bhi])
        open_ -= min(ahi - alo, bhi - blo)
        if k:
            matched += k
            if alo < x and blo < y:
                open_ += min(x - alo, y - blo)
                todo.append((alo, x, blo, y, i, j, n))
            if x + k < ahi and y + k < bhi:
                open_ += min(ahi - x - k, bhi - y - k)
                todo.append((x + k, ahi, y + k, bhi, i, j, n))
        if 2 * (matched + open_) / total < ratio - 1e-6:
            return 0.0
    return 2.0 * matched / total


def _may(p: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, ratio: float) -> np.ndarray:
    """Places of others that could reach the ratio. Every pair that reaches it passes.

    Matching characters are a common subsequence, so at most far characters are deleted or inserted; each changes one
    character count by one and the counts of runs of three by five at most.
    """
    far = (1 - ratio) * (size + sizes) + 1e-6
    at = np.flatnonzero(np.abs(sizes - size) <= far)
    at = at[np.abs(others[at, :CHARS] - p[:CHARS]).sum(axis=1) <= far[at]]
    return at[np.abs(others[at, CHARS:] - p[CHARS:]).sum(axis=1) <= 5 * far[at]]


def _links(rows: pd.DataFrame, ratio: float) -> pd.DataFrame:
    """Links between the texts of two blocks (or in one) that connect the same texts as all their links do."""
    rows = rows.sort_values("id")
    ids, texts = rows["id"].tolist(), rows["t"].tolist()
    left, one = rows["left"].to_numpy(), rows["left"].all()
    sizes, profiles = np.array([len(t) for t in texts]), np.stack([_profile(t) for t in texts])
    places = np.arange(len(ids)) if one else np.flatnonzero(~left)
    others, own = profiles[places], sizes[places]
    root, out, runs, shared = list(range(len(ids))), [], _Runs(CLOSER), _SharedRuns(texts, places)
    total = np.maximum(sizes - RUN + 1, 0)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(left).tolist():
        may = _may(profiles[i], sizes[i], others, own, ratio)
        may = may[places[may] > i] if one else may
        if len(may):
            apart = total[i] + total[places[may]] - 2 * shared.with_all(texts[i])[may]
            may = may[apart <= (2 * RUN - 1) * ((1 - ratio) * (sizes[i] + own[may]) + 1e-6)]
        for j in places[may].tolist():
            x, y = min(i, j), max(i, j)
            if find(x) != find(y) and runs.may(texts[y], texts[x], ratio) and round(_ratio(texts[y], texts[x], ratio), 6) >= ratio:
                root[find(y)] = find(x)
                out.append((ids[x], ids[y]))
    return pd.DataFrame(out, columns=["a", "b"])


def _signature(t: str, bits: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(seeds, counts of characters in buckets, bits of hashes of the runs of SIGNED_RUN characters, the second of equal ones under another hash than the first and so on).

    Differences of the counts, and different bits, are at most those of the characters and runs themselves.
    """
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = np.zeros(max(len(c) - SIGNED_RUN + 1, 0), np.uint64)
    for j in range(SIGNED_RUN if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : len(c) - SIGNED_RUN + 1 + j]
    h.sort()
    place = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), place, 0)) if len(h) else place
    h += (place - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    own = np.zeros(bits, bool)
    own[((h >> np.uint64(33)) & np.uint64(bits - 1)).astype(np.int64)] = True
    counts = np.minimum(np.bincount((c % np.uint64(CHARS)).astype(np.int64), minlength=CHARS), MOST_COUNT).astype("<u2")
    return _seeds(np.unique(c, return_counts=True)[1], len(c)), counts, np.packbits(own, bitorder="little").view("<u8")


def _bits(size: float) -> int:
    """Bits of the signatures of texts of some size."""
    return int(min(MOST_BITS, max(LEAST_BITS, 2 ** math.ceil(math.log2(4 * size + 1)))))


class _Signed:
    """Signatures of texts in a table, by size if they are given at once."""

    def __init__(self, sizes: np.ndarray, seeds: np.ndarray, counts: np.ndarray, bits: np.ndarray):
        self.sizes, self.seeds, self.counts, self.bits, self.n = sizes, seeds, counts, bits, len(sizes)

    @classmethod
    def none(cls, bits: int) -> _Signed:
        """A table to which signatures are added."""
        out = cls(np.zeros(8, np.int64), np.zeros(8, np.int64), np.zeros((CHARS, 8), np.uint16), np.zeros((8, bits // 64), np.uint64))
        out.n = 0
        return out

    @classmethod
    def of(cls, rows: pa.StructArray) -> tuple[_Signed, pa.StructArray]:
        """The signatures of a block, and its rows, both by size."""
        rows = rows.take(pc.sort_indices(rows.field("size")))
        table = lambda name, kind: np.frombuffer(b"".join(rows.field(name).to_pylist()), kind).reshape(len(rows), -1)
        return cls(*(rows.field(c).to_numpy().astype(np.int64) for c in ("size", "seeds")), np.ascontiguousarray(table("counts", "<u2").T), table("bits", "<u8")), rows

    def folded(self, words: int) -> np.ndarray:
        """The signatures' bits in so many words."""
        return self.bits if self.bits.shape[1] == words else np.bitwise_or.reduce(self.bits.reshape(len(self.bits), -1, words), axis=1)

    def add(self, size: int, seeds: int, counts: np.ndarray, bits: np.ndarray) -> None:
        if self.n == len(self.sizes):
            more = lambda x, axis: np.concatenate([x, np.zeros_like(x)], axis)
            self.sizes, self.seeds, self.counts, self.bits = more(self.sizes, 0), more(self.seeds, 0), more(self.counts, 1), more(self.bits, 0)
        self.sizes[self.n], self.seeds[self.n], self.counts[:, self.n], self.bits[self.n] = size, seeds, counts, bits
        self.n += 1

    def may(self, size: int, seeds: int, counts: np.ndarray, bits: np.ndarray, own: np.ndarray, places: slice, ratio: float, open_: np.ndarray | None = None) -> np.ndarray:
        """Those of places (of which only open ones count) whose texts could reach the ratio with a text. Every pair that reaches it passes; own are the bits of these signatures, in as many words as bits."""
        c, p = self.counts[:, places], counts[:, None]
        far = (1 - ratio + ROUNDED) * (size + self.sizes[places]) + 1e-6
        near = ((np.maximum(c, p) - np.minimum(c, p)).sum(axis=0, dtype=np.uint16) <= far) & (np.abs(self.sizes[places] - size) <= far)
        at = np.flatnonzero(near if open_ is None else near & open_[places])
        if not len(at):
            return at
        far, at = far[at], at + places.start
        apart = np.bitwise_count(own[at] ^ bits).sum(axis=1, dtype=np.int64)
        return at[apart <= _most_apart(far, SIGNED_RUN, np.maximum(self.seeds[at], seeds))]


def _block_links(left: pa.StructArray, right: pa.StructArray, same: bool, ratio: float) -> list[tuple]:
    """_links of the texts of two blocks (or in one) with their signatures."""
    (x, rows), (y, others) = _Signed.of(left), _Signed.of(right)
    words = min(x.bits.shape[1], y.bits.shape[1])
    own, met = x.folded(words), y.folded(words)
    runs, out = _Runs(VERIFIED[bool(x.n and x.sizes[-1] > LONG)]), []
    label = np.arange(x.n if same else x.n + y.n)
    of = label[0 if same else x.n :]
    least = ratio - ROUNDED
    last = np.searchsorted(y.sizes, x.sizes * (2 - least) / least + 1, "right")
    first = np.arange(1, x.n + 1) if same else np.searchsorted(y.sizes, x.sizes * least / (2 - least) - 1)
    text = lambda table, k: (table.field("id")[k].as_py(), table.field("t")[k].as_py())
    for i in np.flatnonzero(first < last).tolist():
        at = y.may(int(x.sizes[i]), int(x.seeds[i]), x.counts[:, i], own[i], met, slice(int(first[i]), int(last[i])), ratio, of != label[i])
        for j in at.tolist():
            if of[j] != label[i]:
                (a, earlier), (b, later) = sorted([text(rows, i), text(others, j)], key=lambda r: r[0])
                if runs.may(later, earlier, ratio) and round(_ratio(later, earlier, ratio), 6) >= ratio:
                    label[label == of[j]] = label[i]
                    out.append((a, b))
    return out


def _met(batches: Iterator[pa.RecordBatch], ratio: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            left, right = (b.column(c).slice(k, 1).flatten() for c in ("l", "r"))
            links = _block_links(left, right, b.column("same")[k].as_py(), ratio)
            kind = left.type.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array([x[e] for x in links], kind) for e in (0, 1)], ["a", "b"])


def _kept(batches: Iterator[pa.RecordBatch], ratio: float) -> Iterator[pa.RecordBatch]:
    """(a, b, ratio) of each text b that is alike to a kept one of its class, the first of which is a; rows (label, id, t) come by class and id. Only kept texts are held."""
    label, known, texts, ids, runs = object(), None, [], [], None
    for batch in batches:
        out = []
        for of, i, t in zip(*(batch.column(c).to_pylist() for c in ("label", "id", "t"))):
            if of != label:
                label, texts, ids, runs, bits = of, [], [], _Runs(VERIFIED[len(t) > LONG]), _bits(len(t))
                known = _Signed.none(bits)
            own = len(t), *_signature(t, bits)
            for k in known.may(*own, known.bits, slice(0, known.n), ratio).tolist():
                if runs.may(t, texts[k], ratio) and (r := round(_ratio(t, texts[k], ratio), 6)) >= ratio:
                    out.append((ids[k], i, r))
                    break
            else:
                known.add(*own)
                texts.append(t)
                ids.append(i)
        kind = batch.schema.field("id").type
        yield pa.RecordBatch.from_arrays([pa.array([x[e] for x in out], k) for e, k in enumerate((kind, kind, pa.float64()))], ["a", "b", "ratio"])


def alike_pairs(docs: DataFrame, ratio: float = 0.95, doc_id: str = "doc_id", block: int = 2048) -> DataFrame:
    """(a, b, ratio): each text b whose matching characters reach the ratio with a kept text, and the first such text a.

    Texts are kept or dropped in the order of their ids, and each is compared with every kept one, as if by one after the other.
    Blocks of texts of similar lengths, with signatures, meet all that lengths allow, without a shuffle: counts of characters and bits of runs rule nearly all pairs out without loss,
    then runs themselves, and links give connected classes, whose texts are sent once; in a class the order decides. (A prefix filter of rare runs would not help: a ratio of 0.95 lets every second
    run of five change, and on the tables here such prefixes share more pairs than there are pairs of texts.)
    """
    # Lengths of a pair are of one band or of two neighbours.
    step = math.log((2 - ratio + ROUNDED) / (ratio - ROUNDED)) + 1e-9
    texts = docs.select(F.col(doc_id).alias("id"), F.array_join(T.split_words("text"), " ").alias("t")).where("t <> '' AND id IS NOT NULL")
    own = texts.withColumn("band", F.floor(F.log(F.char_length("t").cast("double")) / step).cast("int"))
    schema = own.schema["id"].dataType.simpleString()
    # A row for each band of lengths, of which there are as many as the logarithm of the longest text.
    bands = own.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.char_length("t")).alias("chars")).collect()
    bits = {r.band: _bits(math.exp((r.band + 1) * step)) for r in bands}
    blocks = {r.band: max(-(-r.n // block), -(-r.chars // BLOCK_CHARS), -(-r.n * (bits[r.band] // 8) // BLOCK_BYTES)) for r in bands}
    n_bytes = sum(r.chars + r.n * (bits[r.band] // 8 + 2 * CHARS) for r in bands)
    columns = f"id {schema}, t string, size int, seeds int, counts binary, bits binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block; rows come by block, and one block is held."""
        at, parts = None, []

        def made() -> pa.RecordBatch:
            rows = pa.concat_arrays(parts)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["band", "salt", "l"])

        for b in batches:
            bands, salts = (b.column(c).to_numpy() for c in ("band", "salt"))
            cuts = np.flatnonzero((bands[1:] != bands[:-1]) | (salts[1:] != salts[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                if at != (now := (int(bands[lo]), int(salts[lo]))):
                    if parts:
                        yield made()
                    at, parts = now, []
                ids, t = b.column("id").slice(lo, hi - lo), b.column("t").slice(lo, hi - lo)
                signed = [(len(x), *_signature(x, bits[at[0]])) for x in t.to_pylist()]
                numbers = [pa.array([x[k] for x in signed], pa.int32()) for k in (0, 1)]
                parts.append(pa.StructArray.from_arrays([ids, t, *numbers, *[pa.array([x[k].tobytes() for x in signed], pa.binary()) for k in (2, 3)]], ["id", "t", "size", "seeds", "counts", "bits"]))
        if parts:
            yield made()

    many = F.broadcast(docs.sparkSession.createDataFrame(list(blocks.items()), "band int, blocks long"))
    dealt = own.join(many, "band").withColumn("salt", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    dealt = dealt.repartition(max(1, min(sum(blocks.values()), max(32, n_bytes // FILE_BYTES))), "band", "salt").groupBy("band", "salt", "t").agg(F.min("id").alias("id"))
    stored = written(dealt.sortWithinPartitions("band", "salt").mapInArrow(sign, f"band int, salt int, l array<struct<{columns.replace(' ', ':').replace(',:', ',')}>>"), "blocks")
    # Each pair of blocks that meet is made where both are read.
    same = (F.col("band2") == F.col("band")) & (F.col("salt2") == F.col("salt"))
    meets = (F.col("band2") == F.col("band") + 1) | ((F.col("band2") == F.col("band")) & (F.col("salt2") >= F.col("salt")))
    pairs = stored.crossJoin(stored.toDF("band2", "salt2", "r")).where(meets).select("l", "r", same.alias("same"))
    links = written(pairs.mapInArrow(lambda batches: _met(batches, ratio), f"a {schema}, b {schema}"), "links")
    named = components(links).select(F.col("node").alias("id"), "label")
    classes = stored.select(F.inline("l")).select("id", "t").join(named, "id").repartition("label").sortWithinPartitions("label", "id")
    return classes.mapInArrow(lambda batches: _kept(batches, ratio), f"a {schema}, b {schema}, ratio double")
