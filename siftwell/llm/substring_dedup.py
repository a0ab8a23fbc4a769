"""Substring dedup by recompression.

Words are [^\\x20\\x09-\\x0D]+, taken as they are. A window of 35 consecutive words of one document whose word
sequence also starts anywhere else is a repeat, and every word that a repeat covers is removed.

Recompression goes in Spark rounds over all documents. A round first replaces runs of a symbol, then pairs of neighbours of which
the first is of one class and the second of another. Which symbols are of which class is decided for all documents at once: of
some divisions all pairs are counted, and the one that joins most is taken. A new symbol's name is a hash, under the round's division, of what it
stands for, so equal substrings get the same names in all documents, but for some at their ends. Every symbol carries the words that its
parse depends on; inside a window those that depend on nothing outside it are the same wherever the window occurs. After the last round four
symbols in a row make a high-level symbol; of these each window picks the one of least name as its anchor, and the windows of one anchor
occurrence form a range. Then high-level symbols are named globally, in a table of those that several windows share:

1. anchors are counted over all documents: one that occurs once has no repeats; one that always has the same
   range, verified by the names of the range's words, repeats with all windows of it;
2. for the others every window is named and counted.

Names of words in a row are made by doubling: of 2, 4, 8 words from two halves, and of any other number from two overlapping
ones, each time by a hash that isn't linear, so no regular sequence of words cancels out.

Documents travel in slices of about a megabyte, and each slice sends an anchor (or window) once, whatever
its number of occurrences, to a bucket of the hash and gets one answer, so a passage that a third of all rows
share is a row per slice. Slices are kept compressed. Windows without an anchor (long runs of one word)
are counted by their own name. Names have 64 bits, and ranges and windows are compared by 64 bits beside
the anchor's.

Null texts have no words. Rows are documents each, so an equal row is a repeat as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siftwell.llm import _kernel as K
from siftwell.llm._store import written

WINDOW = 35
ROUNDS = 2
#: Divisions of symbols into classes that a round chooses from.
DIVISIONS = 4
NAMES = 4
SLICE = 1 << 20
#: Bytes of anchors that a bucket may gather, about.
BUCKET_BYTES = 4 << 20
#: Slices whose rows of a bucket may meet in one task.
GROUP_SLICES = 100_000
_BASE = 0x9FB21C651E98DF25


@dataclass
class Ranges:
    """Of each range of windows: anchor, hash of its words, first word and number of windows."""

    anchor: np.ndarray
    words: np.ndarray
    start: np.ndarray
    size: np.ndarray


@dataclass
class Parsed:
    slice: K.Slice
    words: K.Words
    hashes: np.ndarray
    window: int

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of the words start..end of each span: of two runs of a power of two, that may overlap, and the length."""
        out, size = np.zeros(len(start), K.U64), end - start
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        run, k = self.hashes, 0
        left = np.arange(len(start))
        while len(left):
            now = level[left] == k
            at = left[now]
            out[at] = _join(_join(run[start[at]], run[end[at] - (1 << k)]), size[at].astype(K.U64))
            left = left[~now]
            if len(left):
                run, k = _join(run[: -(1 << k)], run[1 << k :]), k + 1
        return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(a) * K.U64(_BASE) + b)


def _words(s: K.Slice) -> tuple[K.Words, np.ndarray]:
    w = K.find_words(s, K.NOT_SPACE)
    return w, K.word_hashes(s, w)


def parse(s: K.Slice, divisions: list[int], window: int = WINDOW) -> tuple[Parsed, Ranges]:
    w, h = _words(s)
    p = Parsed(s, w, h, window)
    symbols = _Symbols(h, w.first)
    for r, d in enumerate(divisions):
        symbols.runs()
        symbols.pairs(r, d)
    return p, _ranges(p, *symbols.high_level())


def _second(ids: np.ndarray, r: int, division: int) -> np.ndarray:
    """Whether each symbol is of the class that stands second in a pair."""
    return (K.mix(ids ^ K.U64(0xA5A5 + (r << 8 | division))) & K.U64(1)).astype(bool)


class _Symbols:
    """The symbols of a slice's documents: names, the words [lo, hi) that each depends on, and whether a document begins or ends with it.

    What depends on what stands before a document's first word or after its last has a lo or hi beyond it.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = len(ids)
        self.ids, self.begin, self.end = ids, np.zeros(n, bool), np.zeros(n, bool)
        full = np.flatnonzero(np.diff(first))
        self.begin[first[:-1][full]], self.end[first[1:][full] - 1] = True, True
        self.lo, self.hi = np.arange(n), np.arange(1, n + 1)

    def runs(self) -> None:
        """Runs of a symbol become one; each depends on the symbols on both sides, which must differ."""
        ids, begin, end, lo, hi = self.ids, self.begin, self.end, self.lo, self.hi
        if not len(ids):
            return
        new = begin.copy()
        new[1:] |= ids[1:] != ids[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(ids)) - 1
        length = (last - at + 1).astype(K.U64)
        left, right = np.maximum(at - 1, 0), np.minimum(last + 1, len(ids) - 1)
        self.lo, self.hi = np.where(begin[at], lo[at] - 1, lo[left]), np.where(end[last], hi[last] + 1, hi[right])
        self.ids = np.where(length > 1, K.mix(ids[at] + length * K.U64(K._GOLD)), ids[at])
        self.begin, self.end = begin[at], end[last]

    def joins(self, r: int, division: int) -> tuple[np.ndarray, np.ndarray]:
        """Which symbols are second in a pair by a division, and the classes of all."""
        second = _second(self.ids, r, division)
        out = np.zeros(len(second) + 1, bool)
        out[1:-1] = ~second[:-1] & second[1:] & ~self.end[:-1]
        return out, second

    def pairs(self, r: int, division: int) -> None:
        """Pairs become one symbol; a symbol alone depends on its neighbour where that could have joined it."""
        ids, begin, end, lo, hi = self.ids, self.begin, self.end, self.lo, self.hi
        if not len(ids):
            return
        joins, second = self.joins(r, division)
        m = len(ids)
        head = np.flatnonzero(~joins[:m])
        pair = joins[head + 1]
        tail = head + pair
        before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, m - 1)
        free_left, free_right = ~pair & second[head], ~pair & ~second[head]
        self.lo, self.hi = (
            np.where(free_left, np.where(begin[head], lo[head] - 1, lo[before]), lo[head]),
            np.where(free_right, np.where(end[tail], hi[tail] + 1, hi[after]), hi[tail]),
        )
        self.ids = np.where(pair, _join(ids[head], ids[tail]), ids[head])
        self.begin, self.end = begin[head], end[tail]

    def high_level(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of NAMES symbols in a row, and the words [lo, hi) that each depends on."""
        ids, n = self.ids, len(self.ids) - NAMES + 1
        if n < 1:
            return np.zeros(0, K.U64), self.lo[:0], self.hi[:0]
        name = ids[:n]
        for j in range(1, NAMES):
            name = _join(name, ids[j : n + j])
        return name, self.lo[:n], self.hi[NAMES - 1 :]


def choose_divisions(slices: DataFrame, rounds: int = ROUNDS) -> list[int]:
    """The division of each round: that which joins most pairs of all documents, counted in one job a round. The driver gets DIVISIONS sums."""
    chosen: list[int] = []
    for r in range(rounds):

        def count(batches, r=r, before=tuple(chosen)):
            total = np.zeros(DIVISIONS, np.int64)
            for b in batches:
                for blob in b.column(0).to_pylist():
                    w, h = _words(_whole(_unpack(blob)))
                    symbols = _Symbols(h, w.first)
                    for i, d in enumerate(before):
                        symbols.runs()
                        symbols.pairs(i, d)
                    symbols.runs()
                    total += [int(symbols.joins(r, d)[0].sum()) for d in range(DIVISIONS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIVISIONS)), pa.array(total)], names=["division", "pairs"])

        sums = slices.select("rows").mapInArrow(count, "division long, pairs long").groupBy("division").agg(F.sum("pairs").alias("pairs")).collect()
        chosen.append(max(((x.pairs, -x.division) for x in sums), default=(0, 0))[1] * -1)
    return chosen


def _ranges(p: Parsed, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Ranges:
    n, first = len(p.hashes), p.words.first
    count = np.maximum(np.diff(first) - p.window + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    # Window at..at+window has the names from a on (lo >= at) to before b (hi <= at + window).
    below = np.cumsum(np.bincount(np.maximum(lo + 1, 0), minlength=n + 2))
    within = np.cumsum(np.bincount(hi, minlength=n + 2))
    a, b = below[at], within[at + p.window]
    pick = _least(name, a, b)
    none = np.flatnonzero(pick < 0)
    pick[none] = -1 - at[none]
    new = np.ones(len(at), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    start, chosen = at[head], pick[head]
    words = p.names(start, start + size + (p.window - 1))
    anchor = np.where(chosen >= 0, name[np.maximum(chosen, 0)], K.mix(words + K.U64(1))) if len(name) else K.mix(words + K.U64(1))
    return Ranges(anchor, words, start, size)


def _least(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The leftmost place of the least of value[a:b] for each a, b; -1 where there is none."""
    out = np.full(len(a), -1, np.int64)
    own = np.flatnonzero(b > a)
    level = np.zeros(len(a), np.int64)
    level[own] = np.log2(b[own] - a[own] + 0.5).astype(np.int64)
    best, k = np.arange(len(value)), 0
    while len(own):
        here = own[level[own] == k]
        if len(here):
            x, y = best[a[here]], best[b[here] - (1 << k)]
            out[here] = np.where(value[y] < value[x], y, x)
        own = own[level[own] > k]
        if len(own):
            x, y = best[: -(1 << k)], best[1 << k :]
            best = np.where(value[y] < value[x], y, x)
        k += 1
    return out


def _pack(t: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(t)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _u64(parts) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(parts or []), np.uint64))


def _slices(df: DataFrame, text: str) -> DataFrame:
    """(slice, rows): the rows of df in runs of about a megabyte of text, compressed; the text comes last."""
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c != text], F.col(f"`{text}`"))

    def run(batches):
        part, i = TaskContext.get().partitionId(), 0
        for b in batches:
            for s in K.slices(b.column(b.num_columns - 1), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{i}"]), pa.array([_pack(b.slice(s.lo, s.n))], pa.binary())], names=["slice", "rows"])
                i += 1

    return source.mapInArrow(run, "slice string, rows binary")


def _whole(t: pa.RecordBatch) -> K.Slice:
    data, offsets = K.binary_parts(t.column(t.num_columns - 1))
    return K.Slice(0, t.num_rows, data, offsets)


def _to_buckets(slice_: str, bits: int, h: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (bucket, slice, h, words, many) for each bucket of h: the distinct words with their h, and whether they occur twice."""
    order = np.lexsort((words, h))
    h, words = h[order], words[order]
    new = np.ones(len(h), bool)
    new[1:] = (words[1:] != words[:-1]) | (h[1:] != h[:-1])
    head = np.flatnonzero(new)
    many = (np.diff(np.append(head, len(h))) > 1).astype(np.uint8)
    h, words = h[head], words[head]
    bucket = (h >> K.U64(64 - bits)).astype(np.int64)
    cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h))
    parts = [(h[a:b].tobytes(), words[a:b].tobytes(), many[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut[:-1]]), pa.array([slice_] * len(parts)), *[pa.array([x[i] for x in parts], pa.binary()) for i in range(3)]],
        names=["bucket", "slice", "h", "words", "many"],
    )


_SENT = "bucket long, slice string, h binary, words binary, many binary"


def _kinds(h: np.ndarray, least: np.ndarray, most: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct h, sorted: the least and the largest of its words, and how often it occurs."""
    order = np.argsort(h, kind="stable")
    h, least, most, times = h[order], least[order], most[order], times[order]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    if not len(head):
        return h, least, most, times
    return h[head], np.minimum.reduceat(least, head), np.maximum.reduceat(most, head), np.add.reduceat(times, head)


def _verdict(h: np.ndarray, least: np.ndarray, most: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The h that repeat with one range, and those that occur with several."""
    open_ = least != most
    return h[~open_ & (times > 1)], h[open_]


def _gathered(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h, words and occurrences of the rows (slice, h, words, many) of a bucket."""
    h, words = (np.frombuffer(b"".join(r[i] for r in rows), np.uint64) for i in (1, 2))
    return h, words, 1 + np.frombuffer(b"".join(r[3] for r in rows), np.uint8).astype(np.int64)


def _said(rows: list[tuple], sure: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
    """(slice, sure, open): which of each row's own h are among these."""
    out = []
    for name, packed, *_ in rows:
        own = np.frombuffer(packed, np.uint64)
        x, y = own[_in(own, sure)], np.unique(own[_in(own, open_)])
        if len(x) or len(y):
            out.append((name, x.tobytes(), y.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), *[pa.array([r[i] for r in out], pa.binary()) for i in (1, 2)]], names=["slice", "sure", "open"])


def _by_bucket(batches, keys: int, judge) -> Iterator[pa.RecordBatch]:
    """judge(key, rows) for the rows of each key (the first columns), which come one after the other."""
    now, held = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[:keys] != now:
                if held:
                    yield judge(now, held)
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield judge(now, held)


def _answers(sent: DataFrame, groups: int = 1) -> DataFrame:
    """(slice, sure, open): for each slice the h that repeat with one range, and those that occur with several.

    A bucket's rows meet in one task, at most GROUP_SLICES of them. Of more slices each group first sums up its own rows, the sums meet, and
    what they say goes back to every group.
    """
    if groups == 1:

        def run(batches):
            def judge(_, rows):
                h, words, times = _gathered(rows)
                return _said(rows, *_verdict(*_kinds(h, words, words, times)))

            yield from _by_bucket(batches, 1, judge)

        return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "slice string, sure binary, open binary")
    keyed = written(sent.select("bucket", F.pmod(F.xxhash64("slice"), F.lit(groups)).alias("part"), "slice", "h", "words", "many"), "sent")

    def sums(batches):
        def judge(key, rows):
            h, words, times = _gathered(rows)
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), *[pa.array([x.tobytes()], pa.binary()) for x in _kinds(h, words, words, times)]], names=["bucket", "h", "least", "most", "times"])

        yield from _by_bucket(batches, 2, judge)

    def meet(batches):
        def judge(key, rows):
            h, least, most = (np.frombuffer(b"".join(r[i] for r in rows), np.uint64) for i in range(3))
            said = _verdict(*_kinds(h, least, most, np.frombuffer(b"".join(r[3] for r in rows), np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), *[pa.array([x.tobytes()], pa.binary()) for x in said]], names=["bucket", "sure", "open"])

        yield from _by_bucket(batches, 1, judge)

    partial = keyed.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(sums, "bucket long, h binary, least binary, most binary, times binary")
    whole = partial.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "bucket long, sure binary, open binary")
    none = F.lit(None).cast("binary")
    said = whole.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("slice"), F.col("sure").alias("h"), F.col("open").alias("words"))
    asked = keyed.select("bucket", F.col("part").cast("long").alias("part"), F.lit(1).alias("turn"), "slice", "h", none.alias("words"))

    def answer(batches):
        sure = open_ = np.zeros(0, np.uint64)
        for b in batches:
            turn, name, h, words = (b.column(c).to_pylist() for c in ("turn", "slice", "h", "words"))
            for t, *row in zip(turn, name, h, words):
                if t == 0:
                    sure, open_ = np.frombuffer(row[1], np.uint64), np.frombuffer(row[2], np.uint64)
                else:
                    yield _said([tuple(row)], sure, open_)

    return said.unionByName(asked).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "turn").mapInArrow(answer, "slice string, sure binary, open binary")


def _per_slice(answers: DataFrame) -> DataFrame:
    """Answers gathered by slice: at most as many as it sent."""
    return answers.groupBy("slice").agg(F.collect_list("sure").alias("sure"), F.collect_list("open").alias("open"))


def _bits(size: int) -> int:
    return max(8, int(np.ceil(np.log2(max(size, 1) / BUCKET_BYTES + 1))))


def _windows_of(p: Parsed, r: Ranges, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, anchor and hash of every window of the chosen ranges."""
    size = r.size[chosen]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(r.start[chosen], size)
    return at, np.repeat(r.anchor[chosen], size), p.names(at, at + p.window)


def dedup(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """df with text as the words that stay, joined by one space, and n_words and n_removed (replaced if there).

    The text column comes last, before the counts.
    """
    df = df.drop("n_words", "n_removed")
    slices = written(_slices(df, text), "slices")
    of = slices.agg(F.sum(F.length("rows")).alias("bytes"), F.count("*").alias("n")).first()
    bits, groups = _bits(of.bytes or 0), max(1, -(-of.n // GROUP_SLICES))
    divisions = choose_divisions(slices)

    def send(batches):
        for b in batches:
            for name, blob in zip(*[b.column(i).to_pylist() for i in (0, 1)]):
                _, r = parse(_whole(_unpack(blob)), divisions, window)
                if len(r.anchor):
                    yield from _to_buckets(name, bits, r.anchor, r.words)

    anchors = written(_per_slice(_answers(slices.mapInArrow(send, _SENT), groups)), "anchors")

    def send_windows(batches):
        for b in batches:
            for name, blob, open_ in zip(*[b.column(c).to_pylist() for c in ("slice", "rows", "open")]):
                p, r = parse(_whole(_unpack(blob)), divisions, window)
                _, h, words = _windows_of(p, r, np.flatnonzero(_in(r.anchor, _u64(open_))))
                if len(h):
                    # A window is one range with itself: its hash takes the place of the anchor.
                    yield from _to_buckets(name, bits, K.mix(h ^ words * K.U64(_BASE)), words)

    asked = slices.join(anchors.select("slice", "open").where(F.exists("open", lambda x: F.length(x) > 0)).hint("merge"), "slice")
    windows = _per_slice(_answers(asked.mapInArrow(send_windows, _SENT), groups)).select("slice", F.col("sure").alias("repeated"))
    known = written(anchors.join(windows, "slice", "left"), "repeats")
    rows = slices.join(known.hint("merge"), "slice", "left")
    schema = StructType([*[f for f in df.schema.fields if f.name != text], df.schema[text], StructField("n_words", LongType()), StructField("n_removed", LongType())])

    def finish(batches):
        for b in batches:
            for blob, sure, open_, repeated in zip(*[b.column(c).to_pylist() for c in ("rows", "sure", "open", "repeated")]):
                t = _unpack(blob)
                p, r = parse(_whole(t), divisions, window)
                n = len(p.hashes)
                cover = np.zeros(n + 1, np.int64)
                own = np.flatnonzero(_in(r.anchor, _u64(sure)))
                np.add.at(cover, r.start[own], 1)
                np.add.at(cover, r.start[own] + r.size[own] + (window - 1), -1)
                at, h, words = _windows_of(p, r, np.flatnonzero(_in(r.anchor, _u64(open_))))
                at = at[_in(K.mix(h ^ words * K.U64(_BASE)), _u64(repeated))]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                yield _without(t, p, np.cumsum(cover[:n]) > 0, schema.names)

    return rows.mapInArrow(finish, schema)


def _without(t: pa.RecordBatch, p: Parsed, gone: np.ndarray, names: list[str]) -> pa.RecordBatch:
    w, n = p.words, t.num_rows
    stay = np.flatnonzero(~gone)
    doc = w.doc[stay]
    size = w.end[stay] - w.start[stay] + 1
    if len(stay):
        size[np.flatnonzero(np.diff(doc, append=-1))] -= 1  # no space after a document's last word
    ends = np.cumsum(size)
    source = np.arange(int(size.sum())) - np.repeat(ends - size, size) + np.repeat(w.start[stay], size)
    spaces = ends[size > w.end[stay] - w.start[stay]] - 1
    source[spaces] = 0
    out = p.slice.data[source]
    out[spaces] = 0x20
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(doc, size, minlength=n).astype(np.int64), out=offsets[1:])
    texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
    column = t.column(t.num_columns - 1)
    if column.null_count:
        texts = pc.if_else(column.is_null(), pa.scalar(None, pa.large_string()), texts)
    total, removed = np.diff(w.first), np.bincount(w.doc[gone], minlength=n)
    return pa.RecordBatch.from_arrays([*t.columns[:-1], texts.cast(column.type), pa.array(total.astype(np.int64)), pa.array(removed.astype(np.int64))], names)
