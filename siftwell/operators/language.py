"""Languages of documents and queries by log-probabilities of runs of three letters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from siftwell.functions import text as T

#: Buckets of runs; a model has as many numbers for each language.
BUCKETS = 1 << 15
#: Documents that a model is fitted on, at most.
SAMPLE = 20_000
#: Characters that a task scores at once.
CHARS = 1 << 20
#: Romance languages, hard to tell apart in short texts, and the one taken then.
ROMANCE, PREFERRED = ("fr", "pt", "es", "it"), "fr"


def letters(text: Column) -> Column:
    """Words of letters in lower case, a space before and after each; null as nothing."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "), F.lit(" "))


def _runs(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bucket, text) of the runs of texts lo to hi, without those that are spaces twice."""
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) < CHARS:
            size += len(texts[hi])
            hi += 1
        c = np.frombuffer("\n".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        line = c == 10  # letters() leaves no line ends
        of = np.cumsum(line)
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        keep = ~(line[:-2] | line[1:-1] | line[2:]) & ((c[:-2] != 32) | (c[1:-1] != 32)) & ((c[1:-1] != 32) | (c[2:] != 32))
        yield lo, hi, (h >> np.uint64(49)).astype(np.int64)[keep], of[:-2][keep]
        lo = hi


@dataclass
class Model:
    """Log-probabilities (languages, BUCKETS) of the runs of each language."""

    names: list[str]
    weights: np.ndarray

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): shares if all languages were equally likely before."""
        total = np.zeros((len(texts), len(self.names)))
        for lo, hi, bucket, of in _runs(texts):
            for j, w in enumerate(self.weights):
                total[lo:hi, j] = np.bincount(of, w[bucket], hi - lo)
        p = np.exp(np.maximum(total - total.max(axis=1, keepdims=True, initial=-np.inf), -700)) if len(self.names) else total
        return p / p.sum(axis=1, keepdims=True) if len(self.names) else p


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the documents with a language of at most sample ids, in the order of a hash; rows of an id all count, those without one do not."""
    whole = docs.where(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(doc_id).alias("h"), lang, text)
    # Only hashes go to one task; at most sample numbers are broadcast.
    own = whole.join(F.broadcast(whole.select("h").distinct().orderBy("h").limit(sample)), "h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).dictionary_encode()
            at = names.indices.to_numpy()
            for lo, hi, bucket, of in _runs(b.column(1).to_pylist()):
                key, n = np.unique(at[lo:hi][of] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(key // BUCKETS)), pa.array(key % BUCKETS), pa.array(n)], ["lang", "bucket", "n"])

    counted = own.select(F.col(lang).cast("string"), letters(F.col(text)).alias("t")).mapInArrow(run, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS a language
    names = sorted(set(rows["lang"].to_pylist()))
    counts = np.full((len(names), BUCKETS), 0.5)
    counts[np.searchsorted(names, rows["lang"].to_pylist()) if names else np.zeros(0, int), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return Model(names, np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts)


def with_languages(df: DataFrame, model: Model, text: str = "text", name: str = "languages") -> DataFrame:
    """df with an array of struct(lang, prob), the likeliest first; null for texts without letters."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = ArrayType(StructType([StructField("lang", StringType()), StructField("prob", DoubleType())]))
    names = [f"_{i}" for i in range(len(df.columns))]
    own = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)], letters(F.col(f"`{text}`")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column("t").to_pylist()
            p = m.probabilities(texts)
            order = np.argsort(-p, axis=1, kind="stable")
            out = [None if not t.strip() or not m.names else [{"lang": m.names[j], "prob": float(r[j])} for j in o] for t, r, o in zip(texts, p, order)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("prob", pa.float64())])))], [*names, "l"])

    made = own.mapInArrow(run, StructType([*[StructField(n, f.dataType) for n, f in zip(names, df.schema)], StructField("l", kind)]))
    return made.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names)], F.col("l").alias(name))


def language(text: Column, languages: Column, least: int = 50) -> Column:
    """The likeliest language; null for texts of fewer than least characters and those without letters."""
    return F.when(F.char_length(text) >= least, F.get(languages, F.lit(0))["lang"])


def language_or(text: Column, languages: Column, fallback: str = "en", least: int = 50, detect: bool = True) -> Column:
    """The likeliest language, or fallback where detection is off, the text short, null or without letters."""
    return F.coalesce(language(text, languages, least), F.lit(fallback)) if detect else F.lit(fallback)


def query_language(text: Column, languages: Column) -> Column:
    """Of at least three characters the likeliest language, if its probability is 0.5 or more.

    If the next is closer than 0.2, and the preferred one is among the first three, it is that.
    """
    best, second = F.get(languages, F.lit(0)), F.get(languages, F.lit(1))
    close = second.isNotNull() & (best["prob"] - second["prob"] < 0.2) & F.exists(F.slice(languages, 1, 3), lambda x: x["lang"] == PREFERRED)
    named = F.when(close, F.lit(PREFERRED)).otherwise(best["lang"])
    return F.when((F.char_length(T.strip(text)) >= 3) & (best["prob"] >= 0.5), named)
