"""Array kernels over a run of documents held as one byte buffer.

Every operator here that works on words does so on slices of some megabytes: the texts of an Arrow
batch are one byte array with offsets, words are found by table lookup and hashed by lanes of
eight bytes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); a bijection."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Words as runs of anything but ASCII white space: [^\x20\x09-\x0D]+
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of lower-cased text: [0-9a-z_] and every character beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0x80, 0xFF))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for U+00C0 to U+00DE, in place in UTF-8."""
    out = FOLD[data]
    if len(out) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[up] += 32
    return out


@dataclass
class Slice:
    """Rows lo..hi of a batch; text i is data[offsets[i]:offsets[i+1]]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    binary = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1, binary.offset * 8)
    raw = binary.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of whole texts of about limit bytes; a longer text is a run of its own."""
    if not len(column):
        return
    data, offsets = binary_parts(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    """first[i] is the number of words before text i; it has one entry more than there are texts."""


def find_words(s: Slice, is_word: np.ndarray, data: np.ndarray | None = None) -> Words:
    data = s.data if data is None else data
    n = len(data)
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[s.offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, s.offsets, "left")
    doc = np.repeat(np.arange(s.n), np.diff(first))
    return Words(start, end, doc, first)


#: The bytes of an 8-byte lane that the first 0 to 8 of a span are.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes of a block; longer spans are hashed by the hashes of their blocks.
_BLOCK = 64


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte of data on, as numbers, for span_hash."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_hash(lane: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, equal for equal bytes wherever they stand.

    Lanes of eight bytes are mixed in one after the other, so work goes with spans and lanes and not with bytes; spans of up to eight
    bytes and one length never collide. Of longer spans than a block first the blocks are hashed, and then their hashes.
    """
    size = end - start
    out = np.empty(len(start), U64)
    long = size > _BLOCK
    short = np.flatnonzero(~long) if long.any() else slice(None)
    out[short] = _fold(lane, start[short], size[short])
    if long.any():
        n = -(-size[long] // _BLOCK)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(start[long], n) + nth * _BLOCK
        blocks = _fold(lane, first, np.minimum(np.repeat(end[long], n) - first, _BLOCK))
        ends = np.cumsum(n) * 8
        of = span_hash(lanes(blocks.view(np.uint8)), ends - n * 8, ends)
        out[long] = mix(of ^ size[long].astype(U64) * U64(_BASE))
    return out


def _fold(lane: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = mix(mix(size.astype(U64) + U64(_GOLD)) ^ (lane[start] & _FIRST[np.minimum(size, 8)]))
    more, k = np.flatnonzero(size > 8), 8
    while len(more):
        left = size[more] - k
        h[more] = mix(h[more] * U64(_BASE) + (lane[start[more] + k] & _FIRST[np.minimum(left, 8)]))
        k += 8
        more = more[left > 8]
    return h


def word_hashes(s: Slice, w: Words, data: np.ndarray | None = None) -> np.ndarray:
    return span_hash(lanes(s.data if data is None else data), w.start, w.end)


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of size words of one text, and the text of each.

    A text of fewer words, but one at least, has a single shingle of all its words. They are in the order of texts.
    """
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    count = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    out = np.zeros(len(at), U64)
    for j in range(size):
        out = out * U64(_BASE) + h[at + j]
    if len(short):
        extra = np.array([_short(h[first[i] : first[i + 1]]) for i in short], U64)
        out, doc = np.concatenate([out, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return mix(out), doc


def _short(h: np.ndarray) -> int:
    x = 0x51ED270B
    for v in h.tolist():
        x = (x * _BASE + v) & _MASK
    return x
