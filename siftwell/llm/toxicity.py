"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character trigram model is counted over all documents, by their real characters (lower case, what isn't a letter as a gap), in
tables of a fixed number of cells that grams share by hash. Spans that look disguised (digits or signs next
to letters, letters three times in a row, single letters with one or more separators between them) are decoded: every
character may stand for itself, for the letters it is used for, for nothing when it repeats or separates,
and the cheapest path under the character model is the restored word (Viterbi over pairs of letters).

Features are hashed words and beginnings of words of the text and its restored spans. All that clearly mark
toxic documents of the labelled sample have a weight (so the sample bounds their number); a logistic model of the largest weight, the number of
such words and their share gives the score. An empty or null text has none of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from siftwell.llm import _kernel as K
from siftwell.llm._arrow import with_columns
from siftwell.llm._labels import sample

#: Labelled documents to fit on, at most.
SAMPLE = 8000
#: A feature's log odds, less two standard errors, to have a weight.
CLEAR = 1.5
BEGINNINGS = (4, 5, 6)

#: Letters that a sign is used for.
DISGUISES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou",
}
SEPARATORS = " .-_*"
#: Costs (negative logs) of the channel: a sign for a letter, a sign for itself, a repeated or separating character.
AS_LETTER, AS_ITSELF, AS_NOTHING = 0.7, 7.0, 0.4
#: Characters of spans that a decoder keeps the words of.
KNOWN = 4_000_000

#: Bits of the cells for grams of one, two and three characters (10 MB in all, whatever is counted).
CELLS = (16, 18, 20)
#: Costs that a model keeps beside its tables.
KEPT = 500_000

# Symbols of the character model: 0 for what stands between words, 1 to 26, and characters beyond ASCII by their code point.
_CODE = np.zeros(256, np.int64)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0x41:0x5B] = np.arange(1, 27)
_LETTER = K.byte_class((0x61, 0x7A))
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in DISGUISES]] = True
_SPAN = _LETTER | _SIGN | K.byte_class((0x80, 0xFF))
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in SEPARATORS]] = True


def symbol(c: str) -> int:
    return ord(c) if ord(c) > 127 else int(_CODE[ord(c)])


def symbols(s: K.Slice) -> np.ndarray:
    """The symbols of a slice's texts, two gaps before and after each."""
    data = K.lower_bytes(s.data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    out = _CODE[data[lead]]
    for bits, mask, least in ((2, 0x1F, 0xC0), (3, 0x0F, 0xE0), (4, 0x07, 0xF0)):
        at = np.flatnonzero((data[lead] >= least) & (data[lead] < (256 - (1 << 7 - bits))))
        code = data[lead[at]].astype(np.int64) & mask
        for i in range(1, bits):
            code = code << 6 | data[np.minimum(lead[at] + i, len(data) - 1)] & 0x3F
        out[at] = code
    first = np.searchsorted(lead, s.offsets)
    padded = np.zeros(len(lead) + 2 * s.n + 2, np.int64)
    padded[np.arange(len(lead)) + 2 * np.repeat(np.arange(s.n), np.diff(first)) + 2] = out
    return padded


def _cells(grams: np.ndarray, order: int) -> np.ndarray:
    """Cells of packed grams of order characters, behind those of smaller orders."""
    before = sum(1 << b for b in CELLS[: order - 1])
    return (K.mix(grams.astype(K.U64) * K.U64(K._GOLD) + K.U64(order)) >> K.U64(64 - CELLS[order - 1])).astype(np.int64) + before


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts by cell of the grams of one to three characters of all texts; the driver receives a sum a cell."""
    fields = StructType([StructField("cell", LongType()), StructField("n", LongType())])
    cells = sum(1 << b for b in CELLS)

    def run(batches):
        total = np.zeros(cells, np.int64)
        for b in batches:
            for s in K.slices(b.column(0)):
                x = symbols(s)
                for order, grams in ((1, x[2:]), (2, x[1:-1] << 21 | x[2:]), (3, x[:-2] << 42 | x[1:-1] << 21 | x[2:])):
                    total += np.bincount(_cells(grams, order), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    sums = docs.select(F.col(text).alias("text")).mapInArrow(run, fields).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


class _Kept(dict):
    """Values by key, made when they are first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Costs:
    """costs[a][b][c] is -log p(c | a, b), smoothed by the shorter contexts."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float32)
        one = self.counts[: 1 << CELLS[0]]
        self.total, self.distinct = float(one.sum()), int(np.count_nonzero(one))
        self._clear()

    def __getstate__(self):
        return {"counts": self.counts, "total": self.total, "distinct": self.distinct}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._clear()

    def _clear(self):
        self.made, self.rows = 0, _Kept(lambda a: _Kept(lambda b: _Kept(lambda c: self._cost(a, b, c))))

    def __getitem__(self, a: int):
        if self.made > KEPT:
            self._clear()
        return self.rows[a]

    def n(self, *gram: int) -> float:
        packed = 0
        for c in gram:
            packed = packed << 21 | c
        return float(self.counts[_cells(np.array([packed]), len(gram))[0]])

    def _cost(self, a: int, b: int, c: int) -> float:
        self.made += 1
        one = (self.n(c) + 1) / (self.total + self.distinct + 1)
        two = (self.n(b, c) + 20 * one) / (self.n(b) + 20)
        return -float(np.log((self.n(a, b, c) + 20 * two) / (self.n(a, b) + 20)))


class Decoder:
    """Viterbi decoding of one span, of any length, under the character model."""

    def __init__(self, cost: Costs):
        self.cost = cost
        self.known: dict[str, str] = {}
        self.held = 0

    def __call__(self, span: str) -> str:
        word = self.known.get(span)
        if word is None:
            if self.held > KNOWN:
                self.known.clear()
                self.held = 0
            word = self.known[span] = self._decode(span)
            self.held += len(span) + 40
        return word

    def _decode(self, span: str) -> str:
        """Paths are links back to their last letter, so time and memory grow with the span's length only."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for c in span:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def reach(state, price, path):
                if state not in after or price < after[state][0]:
                    after[state] = (price, path)

            for (a, b), (price, path) in best.items():
                row = self.cost[a][b]
                if c.isascii() and c.isalpha():
                    k = ord(c) - 96
                    reach((b, k), price + row[k], (path, c))
                for letter in DISGUISES.get(c, ""):
                    k = ord(letter) - 96
                    reach((b, k), price + AS_LETTER + row[k], (path, letter))
                    if b == k:
                        reach((a, b), price + AS_LETTER + AS_NOTHING, path)
                if not c.isascii():
                    reach((b, ord(c)), price + row[ord(c)], (path, c))
                elif not c.isalpha():
                    reach((b, 0), price + AS_ITSELF + row[0], (path, c))
                if c == before or c in SEPARATORS:
                    reach((a, b), price + AS_NOTHING, path)
            best, before = after, c
        path = min((price + self.cost[a][b][0], i, path) for i, ((a, b), (price, path)) in enumerate(best.items()))[2]
        word = []
        while path is not None:
            path, c = path
            word.append(c)
        return "".join(reversed(word))


def suspects(s: K.Slice, data: np.ndarray) -> list[tuple[int, str, bool]]:
    """(text, span, spaced) of each span of lower-cased data that looks disguised."""
    raw = data.tobytes()
    return [(d, raw[i:j].decode("utf-8", "ignore"), spaced) for d, i, j, spaced in suspect_places(s, data)]


def suspect_places(s: K.Slice, data: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(text, start, end, spaced) in bytes of data of each span that looks disguised."""
    n, out = len(data), []
    if n < 2:
        return out
    sign = _SIGN[data]
    other = _SPAN[data] & ~sign
    hit = np.zeros(n, bool)
    last = np.zeros(n, bool)
    last[s.offsets[1:][np.diff(s.offsets) > 0] - 1] = True
    inner = ~last[:-2] & ~last[1:-1]
    hit[:-1] = (sign[:-1] & other[1:] | other[:-1] & sign[1:]) & ~last[:-1]
    hit[:-2] |= _LETTER[data[:-2]] & (data[:-2] == data[1:-1]) & (data[:-2] == data[2:]) & inner
    at = np.flatnonzero(hit)
    if len(at):
        w = K.find_words(s, _SPAN, data)
        for i in np.unique(np.searchsorted(w.start, at, "right") - 1).tolist():
            out.append((int(w.doc[i]), int(w.start[i]), int(w.end[i]), False))
    # By characters: single ones with nothing but separators, one or more, between them.
    start = np.flatnonzero((data & 0xC0) != 0x80)
    end = np.append(start[1:], n)
    doc = np.searchsorted(s.offsets, start, "right") - 1
    wide, same = _SPAN[data[start]], doc[1:] == doc[:-1]
    alone = wide.copy()
    alone[1:] &= ~(wide[:-1] & same)
    alone[:-1] &= ~(wide[1:] & same)
    solid = np.cumsum(~_GAP[data[start]])
    one = np.flatnonzero(alone)
    if len(one) < 3:
        return out
    link = np.zeros(len(one) + 1, bool)
    link[1:-1] = (doc[one[1:]] == doc[one[:-1]]) & (solid[one[1:] - 1] == solid[one[:-1]])
    first, final = one[~link[:-1] & link[1:]], one[link[:-1] & ~link[1:]]
    long = np.searchsorted(one, final) - np.searchsorted(one, first) >= 2
    for i, j in zip(first[long].tolist(), final[long].tolist()):
        out.append((int(doc[i]), int(start[i]), int(end[j]), True))
    return out


def _variants(span: str, spaced: bool, decode: Decoder) -> set[str]:
    """The restored word, and the same with its repeats, or its long ones, collapsed; of spaced letters also parts, as words may run together."""
    word = decode(span)
    words = {word, re.sub(r"(.)\1+", r"\1", word), decode(re.sub(r"(.)\1\1+", r"\1", span))}
    if "*" in span:
        words.add(decode(span.replace("*", "")))
    if spaced:
        words |= {word[i : i + k] for k in range(4, 13) for i in range(len(word) - k + 1)}
    return words


def features(texts, decode: Decoder):
    """(slice, hashes, text, word): a hash for each word and each beginning of one; word numbers the words."""
    for s in K.slices(texts):
        data = K.lower_bytes(s.data)
        w = K.find_words(s, K.ALNUM, data)
        sums = K.lanes(data)
        size = w.end - w.start
        every, docs, nums = [K.span_hash(sums, w.start, w.end)], [w.doc], [np.arange(len(size))]
        for k in BEGINNINGS:
            at = np.flatnonzero(size > k)
            every.append(K.span_hash(sums, w.start[at], w.start[at] + k) ^ K.U64(k))
            docs.append(w.doc[at])
            nums.append(at)
        number = len(size)
        extra = [(d, v) for d, span, spaced in suspects(s, data) for v in _variants(span, spaced, decode)]
        if extra:
            raw = [v.encode() for _, v in extra]
            ends = np.cumsum([len(r) for r in raw])
            own = K.lanes(np.frombuffer(b"".join(raw), np.uint8))
            starts = np.concatenate([[0], ends[:-1]])
            of, ids = np.array([d for d, _ in extra]), number + np.arange(len(extra))
            every.append(K.span_hash(own, starts, ends))
            docs.append(of)
            nums.append(ids)
            for k in BEGINNINGS:
                at = np.flatnonzero(ends - starts > k)
                every.append(K.span_hash(own, starts[at], starts[at] + k) ^ K.U64(k))
                docs.append(of[at])
                nums.append(ids[at])
        yield s, np.concatenate(every), np.concatenate(docs), np.concatenate(nums), np.diff(w.first)


@dataclass
class Model:
    """Weighted features by hash, the logistic model's coefficients and the character model (6 MB)."""

    cost: Costs
    hashes: np.ndarray
    weights: np.ndarray
    coefficients: np.ndarray
    decoder: Decoder | None = field(default=None)

    def __post_init__(self):
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.hashes >> K.U64(48)).astype(np.int64)] = True

    def __getstate__(self):
        return {**self.__dict__, "decoder": None}

    def summary(self, texts) -> np.ndarray:
        """(texts, 3): largest weight, log of one and the number of marked words, their share of all words."""
        self.decoder = self.decoder or Decoder(self.cost)
        out = [np.zeros((0, 3))]
        for s, h, doc, word, words in features(texts, self.decoder):
            x = np.zeros((s.n, 3))
            at = np.flatnonzero(self.may[(h >> K.U64(48)).astype(np.int64)])
            if len(self.hashes) and len(at):
                i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                ok = self.hashes[i] == h[at]
                at, i = at[ok], i[ok]
                np.maximum.at(x[:, 0], doc[at], self.weights[i])
                marked = np.unique(np.stack([doc[at], word[at]]), axis=1)[0]
                hits = np.bincount(marked, minlength=s.n)
                x[:, 1], x[:, 2] = np.log1p(hits), hits / np.maximum(words, 1)
            out.append(x)
        return np.concatenate(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.coefficients[0] + x @ self.coefficients[1:]
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 0.05) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method with a small ridge; zeros without rows."""
    a = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(a.shape[1])
    if not len(y):
        return c
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        down = a.T @ (p - y) + ridge * c
        c -= np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(c)), down)
    return c


def clearness(all_pos: int, all_n: int) -> Column:
    """Of a feature in pos of n documents: its log odds, less two standard errors."""
    neg = F.col("n") - F.col("pos")
    odds = F.log((F.col("pos") + 0.5) / (all_pos + 1)) - F.log((neg + 1) / (all_n - all_pos + 1))
    return odds - 2 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (neg + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 2, parts: int = 4, size: int = SAMPLE, text: str = "text") -> Model:
    """The character model of all texts, and weights from at most size labelled documents not held out.

    Of documents of the sample that share their smallest shingle hash (copies mostly) one counts. The driver
    receives the weights of the features that are clear, and three numbers per document.
    """
    cost = Costs(count_trigrams(docs, text))
    own = sample(docs, labels, label, fold, parts, size, text)
    plain = Decoder(cost)

    def bags(texts):
        out, keys = [], []
        for s, h, doc, _, _ in features(texts, plain):
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(s.n + 1))
            out += [np.unique(h[order[a:b]]).tobytes() for a, b in zip(cut, cut[1:])]
            w = K.find_words(s, K.ALNUM)
            g, of = K.shingles(K.word_hashes(s, w), w.first, 3)
            least = np.full(s.n, (1 << 64) - 1, np.uint64)
            np.minimum.at(least, of, g)
            keys += least.view(np.int64).tolist()
        return [pa.array(out, pa.binary()), pa.array(keys, pa.int64())]

    rows = with_columns(own, "text", [StructField("bag", BinaryType()), StructField("near", LongType())], bags, ["doc_id", "label", "text"])
    rows = rows.groupBy("near", "label").agg(F.min_by(F.struct("bag", "text"), F.struct("doc_id", "text")).alias("one")).select("label", "one.*")
    counted = StructType([StructField("h", LongType()), StructField("pos", LongType()), StructField("n", LongType())])

    def count(batches):
        for b in batches:
            sets, y = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()], b.column(0).to_pylist()
            h, at = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
            n, pos = np.bincount(at, minlength=len(h)), np.bincount(at, np.repeat(y, [len(x) for x in sets]), len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(pos.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "pos", "n"])

    totals = rows.agg(F.sum("label").cast("long").alias("pos"), F.count("*").alias("n")).first()
    sums = rows.select("label", "bag").mapInArrow(count, counted).groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    t = sums.select("h", clearness(totals.pos or 0, totals.n).alias("weight")).where(F.col("weight") >= CLEAR).toArrow()
    h = t["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    model = Model(cost, h[order], t["weight"].to_numpy()[order], np.zeros(4))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def summaries(texts):
        x = shared.value.summary(texts)
        return [pa.array(x[:, i]) for i in range(3)]

    fields = [StructField(f"x{i}", DoubleType()) for i in range(3)]
    s = with_columns(rows.select("label", "text"), "text", fields, summaries, ["label"]).toArrow().sort_by([("label", "ascending"), ("x0", "ascending"), ("x1", "ascending"), ("x2", "ascending")])
    model.coefficients = logistic(np.column_stack([s[f"x{i}"].to_numpy() for i in range(3)]), np.asarray(s["label"].to_pylist(), float))
    return model


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df with the score of each text. No shuffle; null texts score as empty ones."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        return [pa.array(shared.value.score(shared.value.summary(texts)), pa.float64())]

    return with_columns(df, text, [StructField(name, DoubleType())], run, keep)


def restore(df: DataFrame, model: Model, text: str = "text", name: str = "restored", keep: list[str] | None = None) -> DataFrame:
    """df with each text in lower case, its disguised spans replaced by what they decode to; null stays null.

    Of spans that overlap the one that starts first is replaced, of these the longest.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        m, out = shared.value, []
        m.decoder = m.decoder or Decoder(m.cost)
        for t in texts.to_pylist():
            if t is not None:
                raw = t.lower().encode()
                data, parts, done = np.frombuffer(raw, np.uint8), [], 0
                for i, j in sorted(((i, j) for _, i, j, _ in suspect_places(K.Slice(0, 1, data, np.array([0, len(data)])), data)), key=lambda x: (x[0], -x[1])):
                    if i >= done:
                        parts += [raw[done:i].decode(), m.decoder(raw[i:j].decode("utf-8", "ignore"))]
                        done = j
                t = "".join(parts) + raw[done:].decode()
            out.append(t)
        return [pa.array(out, pa.string())]

    return with_columns(df, text, [StructField(name, StringType())], run, keep)
