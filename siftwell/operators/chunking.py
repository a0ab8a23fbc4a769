"""Chunkers: a row for each chunk of each document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.vectors import hashed_embeddings

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
#: Texts whose pieces a task holds at once.
TEXTS = 64
#: Sentences whose vectors a task holds at once: 1 MB.
SENTENCES = 2048


def windows(n: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of windows of size over n tokens; the window that reaches the end is the last."""
    step = max(size - overlap, 1)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int") * step), F.lit(step)))


def _exploded(rows: DataFrame, pieces: Column, *keep: str) -> DataFrame:
    """A row for each struct of pieces. Structs are cut from a document's words before, so no row carries all of these."""
    return rows.select(*keep, F.explode(pieces).alias("_p")).select(*keep, "_p.*")


def fixed(docs: DataFrame, size: int = 512, overlap: int = 50, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_index, start_token, end_token, content) over words between white space."""
    own = docs.select(F.col(doc_id).alias("doc_id"), T.split_words("text").alias("w"))

    def piece(at: Column, i: Column) -> Column:
        words = F.slice("w", at + 1, F.lit(size))
        return F.struct(i.alias("chunk_index"), at.alias("start_token"), F.least(at + size, F.size("w")).alias("end_token"), F.array_join(words, " ").alias("content"))

    return _exploded(own, F.transform(windows(F.size("w"), size, overlap), piece), "doc_id")


def sliding(docs: DataFrame, w: int = 1, stride: int = 1, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_index, content): sentences w before to w after each centre; the window that reaches the end is the last."""
    own = docs.select(F.col(doc_id).alias("doc_id"), T.sentences("text").alias("s")).where(F.size("s") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("s") - 1 - w) / stride).cast("int"))

    def piece(i: Column) -> Column:
        lo = F.greatest(i * stride - w, F.lit(0))
        return F.struct(i.alias("chunk_index"), F.array_join(F.slice("s", lo + 1, i * stride + w + 1 - lo), " ").alias("content"))

    centres = F.filter(F.sequence(F.lit(0), last), lambda i: i * stride < F.size("s"))
    return _exploded(own, F.transform(centres, piece), "doc_id")


def parent_child(docs: DataFrame, parent: tuple[int, int] = (2000, 100), child: tuple[int, int] = (400, 100), doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, parent_index, child_index, parent_id, content, parent_content): windows of windows."""
    own = docs.select(F.col(doc_id).alias("doc_id"), T.split_words("text").alias("w"))
    cut = F.transform(windows(F.size("w"), *parent), lambda at, i: F.struct(i.alias("parent_index"), F.slice("w", at + 1, F.lit(parent[0])).alias("pw")))
    parents = _exploded(own, cut, "doc_id").withColumn("parent_content", F.array_join("pw", " "))
    name = F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("parent"), F.col("parent_index").cast("string"), F.substring(F.md5(F.substring("parent_content", 1, 100)), 1, 8))
    pieces = F.transform(windows(F.size("pw"), *child), lambda at, i: F.struct(i.alias("child_index"), F.array_join(F.slice("pw", at + 1, F.lit(child[0])), " ").alias("content")))
    rows = parents.select("doc_id", "parent_index", name.alias("parent_id"), "parent_content", pieces.alias("pieces"))
    return _exploded(rows, F.col("pieces"), "doc_id", "parent_index", "parent_id", "parent_content").select("doc_id", "parent_index", "child_index", "parent_id", "content", "parent_content")


class WordSpans:
    """Places of a text's words; any span's number of words by two searches."""

    def __init__(self, text: str):
        places = [m.span() for m in re.finditer(r"\S+", text)]
        self.starts, self.ends = np.array(places, np.int64).reshape(-1, 2).T.copy()

    def count(self, a, b):
        """How many words a span touches; parts of words count."""
        return np.searchsorted(self.starts, b, "left") - np.searchsorted(self.ends, a, "right")


def split_recursive(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS, keep: bool = True) -> list[str]:
    """Pieces of at most size words where a separator allows it, packed in order.

    A span with more words than size is cut where the first separator starts; parts that are still too long are cut by the
    next one, and neighbours between them are packed. With keep, a part starts with its separator. Blank parts are
    dropped. A packed piece starts with the last overlap words of the one before it, if that has more.
    """
    words, out = WordSpans(text), []

    def parts(a: int, b: int, sep: str) -> np.ndarray:
        """(start, end) of the parts of a span that aren't blank, the separator left out if it isn't kept."""
        if not sep:
            edges = np.arange(a, b + 1)
            return np.stack([edges[:-1], edges[1:]], axis=1)
        edges = np.array([a, *(m.start() for m in re.compile(re.escape(sep)).finditer(text, a, b)), b])
        inner = edges[:-1] + np.where(np.arange(len(edges) - 1) > 0, len(sep), 0)
        own = np.stack([edges[:-1] if keep else inner, edges[1:]], axis=1)
        return own[words.count(inner, edges[1:]) > 0]

    def pack(spans: np.ndarray, sep: str) -> None:
        upto = np.concatenate([[0], np.cumsum(words.count(spans[:, 0], spans[:, 1]))])
        glue, at, carry = "" if keep else sep, 0, ""
        while at < len(spans):
            room = size - (overlap if carry else 0)
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + room, "right")) - 1)
            piece = glue.join([carry] * bool(carry) + [text[x:y] for x, y in spans[at:end].tolist()])
            out.append(piece)
            tail = piece.split()
            carry = " ".join(tail[-overlap:]) if 0 < overlap < len(tail) else ""
            at = end

    # What is still to be done, the next last: (start, end, level) to be cut, or spans to be packed and their separator.
    todo: list[tuple] = [(0, len(text), 0)]
    while todo:
        task = todo.pop()
        if len(task) == 2:
            pack(*task)
            continue
        a, b, level = task
        if words.count(a, b) <= size or level == len(separators):
            out += [text[a:b]] * bool(words.count(a, b))
            continue
        spans = parts(a, b, separators[level])
        long = (words.count(spans[:, 0], spans[:, 1]) > size) & (level + 1 < len(separators))
        cut = np.flatnonzero(np.diff(long) | long[1:] | long[:-1]) + 1
        for group in reversed(np.split(np.arange(len(spans)), cut)):
            if len(group):
                todo.append((*spans[group[0]].tolist(), level + 1) if long[group[0]] else (spans[group], separators[level]))
    return out


def _mapped(docs: DataFrame, doc_id: str, fn: Callable[[str], list[str]]) -> DataFrame:
    """(doc_id, chunk_index, content) of what fn makes of each text; blank pieces are dropped. A task passes on the pieces of TEXTS texts at once."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                of, place, content = [], [], []
                for at, t in enumerate(b.column(1).slice(lo, TEXTS), lo):
                    for i, c in enumerate(fn(t.as_py())):
                        if c.strip():
                            of.append(at)
                            place.append(i)
                            content.append(c)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(place, pa.int32()), pa.array(content, b.column(1).type)], ["doc_id", "chunk_index", "content"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, chunk_index int, content string")


def recursive(docs: DataFrame, size: int = 512, overlap: int = 50, separators: list[str] = SEPARATORS, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_index, content); blank pieces are dropped and leave a gap in the index."""
    return _mapped(docs, doc_id, lambda t: [c.strip() for c in split_recursive(t, size, overlap, separators)])


def split_semantic(sentences: list[str], vectors: np.ndarray | None, threshold: float, least: int, most: int) -> list[str]:
    """Sentences joined until most words are reached, or the next one is unlike and least words are there."""
    unlike = np.zeros(0, np.int64)
    if vectors is not None and len(sentences) > 1:
        unlike = np.flatnonzero(np.einsum("ij,ij->i", vectors[:-1], vectors[1:]) < threshold) + 1
    return _joined(sentences, unlike, least, most)


def _joined(sentences: list[str], unlike: np.ndarray, least: int, most: int) -> list[str]:
    """split_semantic by the numbers of the sentences that are unlike the one before."""
    n = len(sentences)
    upto = np.concatenate([[0], np.cumsum([len(s.split()) for s in sentences], dtype=np.int64)])
    out, at = [], 0
    while at < n:
        # Cuts stand behind sentences: where most words are reached, and at the first unlike neighbour with least words before it.
        full = int(np.searchsorted(upto, upto[at] + most))
        enough = max(at + 1, int(np.searchsorted(upto, upto[at] + least)))
        next_ = int(np.searchsorted(unlike, enough))
        end = max(at + 1, min(full, int(unlike[next_]) if next_ < len(unlike) else n, n))
        out.append(" ".join(sentences[at:end]))
        at = end
    return out


def semantic(docs: DataFrame, threshold: float = 0.3, least: int = 50, most: int = 300, doc_id: str = "doc_id") -> DataFrame:
    """Chunks cut where neighbouring sentences are unlike by a hashed bag-of-words embedding."""
    def run(t: str) -> list[str]:
        s = [x for x in map(str.strip, re.split(r"(?<=[.!?])\s+", t)) if x]
        unlike = [np.zeros(0, np.int64)]
        for lo in range(0, len(s) - 1, SENTENCES):
            v = hashed_embeddings([re.findall(r"\w+", x.lower()) for x in s[lo : lo + SENTENCES + 1]])
            unlike.append(np.flatnonzero(np.einsum("ij,ij->i", v[:-1], v[1:]) < threshold) + lo + 1)
        return _joined(s, np.concatenate(unlike), least, most)

    return _mapped(docs, doc_id, run)


def by_section(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_index, content): a chunk for each Markdown section, its heading line included; what stands before the first heading is chunk 0.

    Headings are found in a text's own lines, so no rows are shuffled.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    own = docs.select(F.col(doc_id).alias("doc_id"), lines.alias("l"))
    heads = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(r"^#{1,6}\s+"), i)), lambda i: i.isNotNull())
    own = own.select("doc_id", "l", F.concat(F.array(F.lit(0)), heads).alias("at"))
    # The first section starts at line 0; where a heading stands there, section 0 is empty and dropped.
    ends = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("l")))
    cut = F.transform("at", lambda a, i: F.struct(i.alias("chunk_index"), T.strip(F.array_join(F.slice("l", a + 1, F.get(ends, i) - a), "\n")).alias("content")))
    return _exploded(own, cut, "doc_id").where("content <> ''")


def chunk(docs: DataFrame, strategy: str, **options) -> DataFrame:
    """The chunker of a strategy's name."""
    made = {
        "fixed_size": fixed, "recursive": recursive, "semantic": semantic, "sliding_window": sliding, "parent_child": parent_child,
        "sentence_based": lambda d, **o: sliding(d, 1, 1, **o), "paragraph_based": lambda d, **o: recursive(d, separators=["\n\n", "\n"], **o), "markdown_header": by_section,
    }
    if strategy not in made:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return made[strategy](docs, **options)
