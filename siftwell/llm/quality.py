"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The score is a logistic function of bias + linear terms + low-rank pairwise terms; the pairwise sum takes
time linear in the features, as half of (sum of vx)**2 - sum of (vx)**2 for each factor. Features come from
the bytes of the text (counts of hashed words, and numbers on its size, its symbols, its words and its repetition) and from
numeric metadata columns that the caller names, each as the signed logarithm of its value and whether it is missing (null or not a
number). An empty or null text has no words and statistics of 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, DoubleType, StructField

from siftwell.llm import _kernel as K
from siftwell.llm._arrow import with_columns
from siftwell.llm._labels import sample

BUCKETS = 1024
FACTORS = 8
#: Labelled documents to fit on, at most.
SAMPLE = 4000
ROWS = 2048
STATS = (
    "bytes", "words", "word_bytes", "pipes", "symbols", "digits", "upper", "stops", "breaks", "beyond_ascii",
    "distinct_words", "doubled_words", "symbol_ends", "distinct_lines", "most_common_word", "long_words", "short",
)

_SYMBOL = K.byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_KINDS = np.zeros((256, 7), np.float64)
for _i, _c in enumerate(
    (K.byte_class((0x7C, 0x7C)), _SYMBOL, K.byte_class((0x30, 0x39)), K.byte_class((0x41, 0x5A)), K.byte_class((0x2E, 0x2E)), K.byte_class((0x0A, 0x0A)), K.byte_class((0x80, 0xFF)))
):
    _KINDS[:, _i] = _c


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed words (texts, BUCKETS) and statistics (texts, len(STATS))."""
    counts, stats = [], []
    for s in K.slices(texts):
        for lo in range(0, s.n, ROWS):
            hi = min(lo + ROWS, s.n)
            at = s.offsets[lo : hi + 1]
            c, x = _slice(K.Slice(0, hi - lo, s.data[at[0] : at[-1]], at - at[0]))
            counts.append(c)
            stats.append(x)
    if not counts:
        return np.zeros((0, BUCKETS), np.float32), np.zeros((0, len(STATS)))
    return np.concatenate(counts), np.concatenate(stats)


def _slice(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    n, size = s.n, np.diff(s.offsets).astype(np.float64)
    data = K.lower_bytes(s.data)
    w = K.find_words(s, K.NOT_SPACE)
    h = K.word_hashes(s, w, data)
    per = np.diff(w.first).astype(np.float64)
    bucket = (h >> K.U64(54)).astype(np.int64)
    counts = np.bincount(w.doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    one, words = np.maximum(size, 1), np.maximum(per, 1)
    doc = np.repeat(np.arange(n), np.diff(s.offsets))
    by_byte = np.bincount(doc * 256 + s.data, minlength=n * 256).reshape(n, 256)
    kinds = (by_byte @ _KINDS) / one[:, None]
    new, d = _distinct(w.doc, h)
    run = np.diff(np.append(np.flatnonzero(new), len(new)))
    most = np.zeros(n)
    np.maximum.at(most, d[new], run)
    doubled = np.zeros(len(h), bool)
    doubled[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    long = (w.end - w.start) > 24
    ends = _SYMBOL[s.data[w.end - 1]] if len(w.end) else np.zeros(0, bool)
    lines = K.find_words(s, ~K.byte_class((0x0A, 0x0A)))
    lh = K.span_hash(K.lanes(s.data), lines.start, lines.end)
    lnew, ld = _distinct(lines.doc, lh)
    total = lambda x, at: np.bincount(at, x, minlength=n)
    stats = np.column_stack((
        np.log1p(size), np.log1p(per), total(w.end - w.start, w.doc) / words, *kinds.T,
        total(new, d) / words, total(doubled, w.doc) / words, total(ends, w.doc) / words,
        total(lnew, ld) / np.maximum(np.diff(lines.first), 1), most / words, total(long, w.doc) / words, 1 / (1 + per),
    ))
    stats[size == 0] = 0
    return counts, stats


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With hashes sorted within each text (ROWS takes 11 bits): where a new one starts, and the texts."""
    key = np.sort(doc.astype(K.U64) << K.U64(52) | h >> K.U64(12))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return new, (key >> K.U64(52)).astype(np.int64)


def metadata_features(columns) -> np.ndarray:
    """(rows, 2 * columns): of each Arrow column its signed logarithm and whether it is missing."""
    out = []
    for c in columns:
        x = c.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        there = np.isfinite(x)
        x = np.where(there, x, 0)
        out += [np.sign(x) * np.log1p(np.abs(x)), ~there]
    return np.array(out, np.float64).T


def _all(texts, *columns) -> tuple[np.ndarray, np.ndarray]:
    counts, stats = features(texts)
    return counts, np.concatenate([stats, metadata_features(columns).reshape(len(stats), -1)], axis=1)


@dataclass
class Machine:
    """A fitted machine: standardisation of the statistics, bias, linear weights, factors and metadata columns. Under 100 KB."""

    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    metadata: tuple[str, ...] = ()

    def design(self, counts: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = np.log1p(counts)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6)
        z = np.clip((stats - self.mean) / self.scale, -5, 5) / 2
        return np.concatenate([x, z.astype(np.float32)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        pairs = (x @ self.factors) ** 2 - (x * x) @ (self.factors * self.factors)
        return self.bias + x @ self.linear + 0.5 * pairs.sum(axis=1)

    def score(self, counts: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return _logistic(self.margin(self.design(counts, stats)).astype(np.float64))


def _logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def train(counts: np.ndarray, stats: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 512, rate: float = 0.03, decay: float = 1e-4, seed: int = 17) -> Machine:
    """Adam on the log loss over mini-batches, in an order set by seed. Without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    d = BUCKETS + stats.shape[1]
    m = Machine(np.zeros(stats.shape[1]), np.ones(stats.shape[1]), 0.0, np.zeros(d, np.float32), rng.normal(0, 0.02, (d, FACTORS)).astype(np.float32))
    if not len(labels):
        m.factors[:] = 0
        return m
    m.mean, m.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    x = m.design(counts, stats)
    rate_one = np.clip(labels.mean(), 0.001, 0.999)
    m.bias = float(np.log(rate_one / (1 - rate_one)))
    keep = [np.zeros(1 + d), np.zeros(1 + d), np.zeros_like(m.factors), np.zeros_like(m.factors)]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            b, t = x[own], t + 1
            g = ((_logistic(m.margin(b)) - labels[own]) / len(own)).astype(np.float32)
            inner = b @ m.factors
            down = b.T @ (inner * g[:, None]) - m.factors * ((b * b).T @ g)[:, None] + decay * m.factors
            flat = np.concatenate([[g.sum()], b.T @ g + decay * m.linear])
            for k, grad in ((0, flat), (2, down)):
                keep[k] = 0.9 * keep[k] + 0.1 * grad
                keep[k + 1] = 0.999 * keep[k + 1] + 0.001 * grad * grad
            step = [rate * keep[k] / (1 - 0.9**t) / (np.sqrt(keep[k + 1] / (1 - 0.999**t)) + 1e-8) for k in (0, 2)]
            m.bias -= float(step[0][0])
            m.linear -= step[0][1:].astype(np.float32)
            m.factors -= step[1].astype(np.float32)
    return m


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 0, parts: int = 5, size: int = SAMPLE, text: str = "text", metadata: tuple[str, ...] = ()
) -> Machine:
    """A machine fitted on features of at most size labelled documents that are not held out.

    The driver receives 1,024 32-bit counts and some 20 numbers of each, 18 MB at the default size.
    """
    own = sample(docs, labels, label, fold, parts, size, text, metadata)

    def run(*columns):
        c, x = _all(*columns)
        return [pa.array([r.tobytes() for r in c.astype("<f4")], pa.binary()), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())]

    rows = with_columns(own, "text", [StructField("counts", BinaryType()), StructField("stats", BinaryType())], run, ["doc_id", "label"], beside=metadata)
    t = rows.toArrow().sort_by([("doc_id", "ascending"), ("counts", "ascending")]) if size else None
    wide = len(STATS) + 2 * len(metadata)
    if t is None or not t.num_rows:
        m = train(np.zeros((0, BUCKETS), np.float32), np.zeros((0, wide)), np.zeros(0))
    else:
        counts = np.frombuffer(b"".join(t["counts"].to_pylist()), "<f4").reshape(-1, BUCKETS)
        m = train(counts, np.frombuffer(b"".join(t["stats"].to_pylist()), "<f8").reshape(-1, wide), np.asarray(t["label"].to_pylist()))
    m.metadata = metadata
    return m


def score(df: DataFrame, machine: Machine, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df with the score of each text. No shuffle; null texts score as empty ones."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(*columns):
        return [pa.array(shared.value.score(*_all(*columns)), pa.float64())]

    return with_columns(df, text, [StructField(name, DoubleType())], run, keep, beside=machine.metadata)
