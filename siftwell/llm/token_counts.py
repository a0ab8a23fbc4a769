"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: leaves of some 64 pre-tokens (their characters and
numbers of tokens), and above them sums of both. An edit goes down the tree to the last pre-token that cannot
depend on it, encodes from there, and stops at the first place behind the edit where a new pre-token starts at an
old one's start: all that follows is as it was. The leaves between get the new pre-tokens and the sums on their
paths are updated; nothing else is encoded again.

This is exact for patterns without look-behind that read at most CONTEXT characters past a match, as that of
byte-level vocabularies does (a white-space match reads one further space and what follows it).

Null and empty texts have a tree without leaves and 0 tokens. Edits are spans of characters of the text before
any edit; they are cut to the text, a null replacement is empty, and one that starts before the end of an earlier
one (in the order of start, end, replacement), or has a null start or end, is left out.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from siftwell.llm import _kernel as K
from siftwell.llm._arrow import with_columns
from siftwell.llm.bpe import Codec, _Made, here, share

LEAF = 64
#: Leaves are cut anew when one has grown to so many pre-tokens.
FULL = 16 * LEAF
CONTEXT = 2

Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens of a text with their numbers of tokens, by one codec."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.counts = _Made(lambda t: len(codec._token(t)) // 4)
        spaced = codec.pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        import regex

        self.matches = regex.compile(spaced).finditer

    def all(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.codec.pre_tokens(text)
        n = len(pieces)
        return np.fromiter(map(len, pieces), np.uint32, n), np.fromiter(map(self.counts.__getitem__, pieces), np.uint32, n)


def counter(codec: Codec) -> Counter:
    if not hasattr(codec, "_counter"):
        codec._counter = Counter(codec)
    return codec._counter


class Tree:
    """first[i] is the place of leaf i's first pre-token; node 1 is the root, nodes 2i and 2i + 1 are below node i."""

    def __init__(self, lens: np.ndarray, counts: np.ndarray, first: np.ndarray | None = None, sums: np.ndarray | None = None):
        self.lens, self.counts = lens, counts
        self.first = np.append(np.arange(0, len(lens), LEAF), len(lens)) if first is None else first
        self.width = 1 << max(0, (len(self.first) - 2).bit_length())
        self.sums = self._summed() if sums is None else sums

    def _summed(self) -> np.ndarray:
        out = np.zeros((2 * self.width, 2), np.int64)
        n = len(self.first) - 1
        for j, v in enumerate((self.lens, self.counts)):
            total = np.concatenate([[0], np.cumsum(v, dtype=np.int64)])
            out[self.width : self.width + n, j] = np.diff(total[self.first])
        level = self.width
        while level > 1:
            out[level // 2 : level] = out[level : 2 * level : 2] + out[level + 1 : 2 * level : 2]
            level //= 2
        return out

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    def at(self, char: int) -> tuple[int, int]:
        """The last pre-token that starts at char or before: its place and start; the end for the number of characters."""
        if char >= self.n_chars:
            return len(self.lens), self.n_chars
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if start + self.sums[node, 0] <= char:
                start += int(self.sums[node, 0])
                node += 1
        leaf = node - self.width
        lo, hi = int(self.first[leaf]), int(self.first[leaf + 1])
        ends = np.cumsum(self.lens[lo:hi], dtype=np.int64)
        k = int(np.searchsorted(ends, char - start, "right"))
        return lo + k, start + (int(ends[k - 1]) if k else 0)

    def replaced(self, parts: list[tuple[int, int, list[int], list[int]]]) -> Tree:
        """The tree with pre-tokens lo..hi of each part, in order, replaced by others."""
        lens, counts, first, at = [], [], self.first.copy(), 0
        touched: set[int] = set()
        shift = 0
        moved = np.zeros(len(first), np.int64)
        for lo, hi, new, own in parts:
            lens += [self.lens[at:lo], np.array(new, np.uint32)]
            counts += [self.counts[at:lo], np.array(own, np.uint32)]
            a = max(int(np.searchsorted(self.first, lo, "right")) - 1, 0)
            a = min(a, max(len(first) - 2, 0))
            b = int(np.searchsorted(self.first, hi, "left"))
            # Leaves that begin within the part are left with what stands behind it.
            moved[a + 1 : b] = np.maximum(hi - self.first[a + 1 : b], 0)
            grown = len(new) - (hi - lo)
            first[a + 1 :] += grown
            shift += grown
            touched |= set(range(a, max(a + 1, b)))
            at = hi
        lens.append(self.lens[at:])
        counts.append(self.counts[at:])
        x, y = np.concatenate(lens), np.concatenate(counts)
        first = first + moved
        if len(first) < 2 or np.diff(first).max() > FULL:
            return Tree(x, y)
        sums = self.sums.copy()
        for leaf in touched:
            lo, hi = first[leaf], first[leaf + 1]
            node = self.width + leaf
            sums[node] = x[lo:hi].sum(dtype=np.int64), y[lo:hi].sum(dtype=np.int64)
            while node > 1:
                node //= 2
                sums[node] = sums[2 * node] + sums[2 * node + 1]
        return Tree(x, y, first, sums)

    def packed(self) -> bytes:
        wide = 4 if len(self.lens) and max(self.lens.max(), self.counts.max()) > 0xFFFF else 2
        kind = f"<u{wide}"
        head = struct.pack("<III", wide, len(self.lens), len(self.first))
        return b"".join([head, self.lens.astype(kind).tobytes(), self.counts.astype(kind).tobytes(), self.first.astype("<u4").tobytes(), self.sums.astype("<i8").tobytes()])

    @staticmethod
    def unpacked(data: bytes | None) -> Tree:
        if not data:
            return Tree(np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        wide, n, m = struct.unpack_from("<III", data)
        kind, at = f"<u{wide}", 12
        lens, at = np.frombuffer(data, kind, n, at).astype(np.uint32), at + n * wide
        counts, at = np.frombuffer(data, kind, n, at).astype(np.uint32), at + n * wide
        first, at = np.frombuffer(data, "<u4", m, at).astype(np.int64), at + 4 * m
        return Tree(lens, counts, first, np.frombuffer(data, "<i8", -1, at).reshape(-1, 2))


def build(text: str, c: Counter) -> Tree:
    tree = Tree(*c.all(text))
    if tree.n_chars != len(text):
        raise ValueError("the pattern must cover every character")
    return tree


def in_order(edits: list, n: int) -> list[Edit]:
    """Edits that count, cut to a text of n characters."""
    good = sorted((max(0, min(s, n)), max(0, min(e, n)), r or "") for s, e, r in edits if s is not None and e is not None and e >= s)
    out: list[Edit] = []
    for e in good:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def apply_edits(text: str, tree: Tree, edits: list[Edit], c: Counter) -> tuple[str, Tree, int]:
    """The text and tree after edits (as in_order gives them), and the number of pre-tokens encoded anew."""
    if not edits:
        return text, tree, 0
    pieces, last = [], 0
    for s, e, r in edits:
        pieces += [text[last:s], r]
        last = e
    new = "".join([*pieces, text[last:]])
    parts, i, delta, done = [], 0, 0, 0
    while i < len(edits):
        lo, start = tree.at(max(0, edits[i][0] - CONTEXT))
        lens, counts, hi = [], [], len(tree.lens)
        through = -1
        end = start + delta
        matches = c.matches(new, end)
        while True:
            # The next edit belongs here if what is encoded has come to where it would begin.
            while i < len(edits) and (through < 0 or tree.at(max(0, edits[i][0] - CONTEXT))[1] + delta <= end):
                s, e, r = edits[i]
                through = s + delta + len(r)
                delta += len(r) - (e - s)
                i += 1
            if end >= through:
                place, at = tree.at(end - delta)
                if at == end - delta:
                    hi = place
                    break
            m = next(matches, None)
            if m is None:
                break
            lens.append(m.end() - end)
            counts.append(c.counts[m[0]])
            end = m.end()
        parts.append((lo, hi, lens, counts))
        done += len(lens)
    return new, tree.replaced(parts), done


def count(df: DataFrame, codec: Codec, text: str = "text", tree: str = "tree", n_tokens: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """df with the packed tree of each text and its number of tokens. No shuffle."""
    shared = share(df, codec)

    def run(texts):
        c = counter(here(shared))
        trees = [build(t or "", c) for t in texts.to_pylist()]
        return [pa.array([t.packed() for t in trees], pa.binary()), pa.array([t.n_tokens for t in trees], pa.int64())]

    return with_columns(df, text, [StructField(tree, BinaryType()), StructField(n_tokens, LongType())], run, keep)


def recount(
    df: DataFrame,
    codec: Codec,
    edits: str | Callable[[str], list[Edit]],
    text: str = "text",
    tree: str = "tree",
    keep: list[str] | None = None,
) -> DataFrame:
    """keep (or all other columns of df), text, tree, n_tokens, n_edits and n_encoded after edits; columns of these names are replaced.

    edits: a column array<struct<start, end, replacement>>, or a function of the text.
    """
    shared = share(df, codec)
    names = [text, tree, "n_tokens", "n_edits", "n_encoded"]
    gone = {n.lower() for n in [*names, *([edits] if isinstance(edits, str) else [])]}
    stay = [x for x in (df.columns if keep is None else keep) if x.lower() not in gone]
    given = [F.col(f"`{edits}`").alias("__edits")] if isinstance(edits, str) else []
    source = df.select(*[F.col(f"`{x}`") for x in stay], *given, F.col(f"`{tree}`").alias("__tree"), F.col(f"`{text}`").alias("__text"))
    listed = bool(given)
    fields = [StructField(text, StringType()), StructField(tree, BinaryType()), *[StructField(n, LongType()) for n in names[2:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(here(shared))
        for whole in batches:
            for s in K.slices(whole.column(whole.num_columns - 1)):
                b = whole.slice(s.lo, s.hi - s.lo)
                out = []
                own = b.column(len(stay)).to_pylist() if listed else None
                for i, (t, x) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
                    asked = [tuple(e.values()) for e in own[i] or [] if e is not None] if listed else edits(x or "")
                    todo = in_order(asked, len(x or ""))
                    new, after, n = apply_edits(x or "", Tree.unpacked(t), todo, c)
                    out.append((new if x is not None or todo else None, after.packed(), after.n_tokens, len(todo), n))
                arrays = [pa.array(v, k) for v, k in zip(zip(*out), (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(stay)], *arrays], [*stay, *names])

    return source.mapInArrow(run, StructType(source.schema.fields[: len(stay)] + fields))


_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_NUMBER = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}|\d[\d -]{6,}\d")


def masks(text: str) -> list[Edit]:
    """Edits that put a mark in the place of e-mail addresses, IP addresses and long numbers."""
    out = [(m.start(), m.end(), "[EMAIL]") for m in _MAIL.finditer(text)] if "@" in text else []
    return out + [(m.start(), m.end(), "[NUMBER]") for m in _NUMBER.finditer(text)]
