"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is itself an entry; any
other pre-token is merged with a heap of pair ranks over a linked list of its bytes. Results are kept per
worker in dictionaries of bounded size, as words repeat.

Null and empty texts have no ids. Ids are 32-bit unsigned little-endian, packed in a binary column.
"""

from __future__ import annotations

import base64
import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from siftwell.llm._arrow import with_columns

#: Entries of a generation of a worker's results, of which two are kept.
CACHE_ENTRIES = 300_000
CACHE_LENGTH = 64


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file (base64 token, rank), by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


class PerfectHash:
    """Minimal perfect hash by displacement: n keys take n slots, one per key.

    Keys fall into buckets of about four; from the largest bucket on, each gets the first displacement
    that sends its keys to free slots. A bucket of one key holds its slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        for seed in range(16):
            if self._build(keys, seed):
                return
        raise ValueError("no perfect hash found; are the keys distinct?")

    def _build(self, keys: list[bytes], seed: int) -> bool:
        self.seed, n = seed, self.n
        h = np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        a, b = ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64), self._step(h)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(counts) - counts
        move, slots, taken = np.zeros(self.buckets, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        tries = np.arange(64)[:, None]
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] < 2:
                break
            own = order[first[k] : first[k] + counts[k]]
            for base in range(0, 1 << 20, 64):
                at = np.sort((a[own] + (base + tries) * b[own]) % n, axis=1)
                good = np.flatnonzero(~(taken[at].any(axis=1) | (at[:, 1:] == at[:, :-1]).any(axis=1)))
                if len(good):
                    d = base + int(good[0])
                    at = (a[own] + d * b[own]) % n
                    taken[at], slots[at], move[k] = True, own, d
                    break
            else:
                return False
        free = iter(np.flatnonzero(~taken).tolist())
        for k in np.flatnonzero(counts == 1):
            s = next(free)
            slots[s], move[k] = order[first[k]], -s - 1
        self.move, self.slots = move.tolist(), slots.tolist()
        return True

    def _step(self, h: np.ndarray) -> np.ndarray:
        return (((h >> np.uint64(16)) & np.uint64(0xFFFFFF)) | np.uint64(1)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        """The only number whose key may be key; the caller compares."""
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.move[h % self.buckets]
        return self.slots[-d - 1 if d < 0 else ((h >> 40) % self.n + d * ((h >> 16) & 0xFFFFFF | 1)) % self.n]


class _Made(dict):
    """A dictionary that makes missing values by a function.

    When it is full a new generation begins; what is asked for again is taken over from the last one, so common words stay.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.last = make, {}

    def __missing__(self, key):
        value = self.last.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_LENGTH and "\n" not in key:
            if len(self) >= CACHE_ENTRIES:
                self.last = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary; made once on the driver and once more in each worker."""

    def __init__(self, vocab: list[bytes], pattern: str, hashed: PerfectHash | None = None):
        self.vocab, self.pattern = vocab, pattern
        self.hashed = hashed or PerfectHash(vocab)
        self.ready = False

    def __getstate__(self):
        return {"vocab": self.vocab, "pattern": self.pattern, "hashed": self.hashed, "ready": False}

    def prepare(self) -> Codec:
        if not self.ready:
            self.rank = {t: i for i, t in enumerate(self.vocab)}
            # White space as Unicode's property has it, which leaves out U+001C to U+001F.
            spaced = self.pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
            self.find = regex.compile(spaced).findall
            self.tokens, self.led = _Made(self._token), _Made(self._led)
            self.byte_ids = [self.rank[bytes([i])] for i in range(256)]
            self.byte_pairs = [[self.rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
            self.ready = True
        return self

    def pre_tokens(self, text: str) -> list[str]:
        return self.find(text)

    def encode(self, text: str) -> bytes:
        """The ids of text, packed.

        Where each space stands before something visible, every space starts a pre-token and what
        follows it up to the next space can be looked up as a whole.
        """
        if not text:
            return b""
        if _RUN.search(text):
            return b"".join(map(self.tokens.__getitem__, self.find(text)))
        head, *rest = text.split(" ")
        return b"".join([*map(self.tokens.__getitem__, self.find(head)), *map(self.led.__getitem__, rest)])

    def _led(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._token(" " + piece)
        if piece[-1] in ".," and piece[:-1].isalpha():
            return self.led[piece[:-1]] + self.tokens[piece[-1]]
        return b"".join(map(self.tokens.__getitem__, self.find(" " + piece)))

    def _token(self, token: str) -> bytes:
        key = token.encode("utf-8", "replace")
        i = self.hashed.slot(key)
        if self.vocab[i] == key:
            return struct.pack("<I", i)
        return self._merge(key)

    def _merge(self, word: bytes) -> bytes:
        """Merge the pair of least rank, the leftmost of these, until no pair has a rank.

        Slot i of the lists is the part that starts at byte i: the starts after and before it, its id, and the
        rank of its pair with the next part. An entry of the heap counts while the pair still has its rank.
        """
        n, rank, pair, push = len(word), self.rank.get, self.byte_pairs, heappush
        # An entry is a rank and, in its low bits, a start; short words have entries of one machine digit.
        bits = n.bit_length()
        low = (1 << bits) - 1
        own = [pair[a][b] for a, b in zip(word, word[1:])]
        heap = [r << bits | i for i, r in enumerate(own) if r >= 0]
        ids = list(map(self.byte_ids.__getitem__, word))
        if not heap:
            return struct.pack(f"<{n}I", *ids)
        heapify(heap)
        own.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            e = heappop(heap)
            i, r = e & low, e >> bits
            if own[i] != r:
                continue
            ids[i] = r
            j = after[i]
            after[i] = k = after[j]
            own[j] = -2
            if k < n:
                before[k] = i
                own[i] = r = rank(word[i : after[k]], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                own[i] = -1
            i = before[i]
            if i >= 0:
                own[i] = r = rank(word[i:k], -1)
                if r >= 0:
                    push(heap, r << bits | i)
        left = [t for t, r in zip(ids, own) if r != -2]
        return struct.pack(f"<{len(left)}I", *left)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(packed, "<u4").tolist()))


#: A space that is not followed by something visible.
_RUN = re.compile(r" (?:\s|\Z)")

_local: dict[str, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def here(shared) -> Codec:
    """This worker's codec of a broadcast one; its caches outlive a task."""
    if shared.id not in _local:
        _local.clear()
        _local[shared.id] = shared.value
    return _local[shared.id].prepare()


class _Shared:
    """A broadcast codec (a vocabulary has a fixed size, under 10 MB) and its name."""

    def __init__(self, spark, value: Codec):
        self.id = f"{len(value.vocab)}-{xxhash.xxh64_hexdigest(b''.join(value.vocab) + value.pattern.encode())}"
        self.broadcast = spark.sparkContext.broadcast(value)

    @property
    def value(self) -> Codec:
        return self.broadcast.value


def share(df: DataFrame, value: Codec) -> _Shared:
    return _Shared(df.sparkSession, value)


def encode(df: DataFrame, value: Codec, text: str = "text", ids: str = "ids", keep: list[str] | None = None, array: bool = False, decoded: str | None = None) -> DataFrame:
    """df with a binary column of packed ids, or an array<long>, and with decoded the bytes that they stand for.

    No shuffle; any column of these names is replaced. Ids are decoded where they were made, so one Python worker a task holds the
    vocabulary and ids aren't sent back and forth.
    """
    shared = share(df, value)

    def run(texts):
        c = here(shared)
        packed = [c.encode(t or "") for t in texts.to_pylist()]
        out = [pa.array([np.frombuffer(p, "<u4").tolist() for p in packed], pa.list_(pa.int64())) if array else pa.array(packed, pa.binary())]
        return out + ([pa.array([c.decode(p) for p in packed], pa.binary())] if decoded else [])

    fields = [StructField(ids, ArrayType(LongType()) if array else BinaryType())]
    return with_columns(df, text, fields + ([StructField(decoded, BinaryType())] if decoded else []), run, keep)


def decode(df: DataFrame, value: Codec, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df with a binary column of the bytes that packed ids stand for; null ids count as none."""
    shared = share(df, value)

    def run(packed):
        c = here(shared)
        return [pa.array([c.decode(p or b"") for p in packed.to_pylist()], pa.binary())]

    return with_columns(df, ids, [StructField(decoded, BinaryType())], run, keep)
