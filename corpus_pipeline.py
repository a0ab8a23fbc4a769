"""A corpus pipeline of five stages over documents; each stage's rows are written and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontaminate, line_dedup, minhash, quality
from siftwell.llm._store import doc_key, written
from siftwell.llm.queries import bpe_digests, table


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject. A null text scores as an empty one."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    name = "quality_score"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return quality.score(docs, machine, name=name).where(F.col(name) >= 0.3).select(_own(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; n_chars follows. A null text stays null, and then n_chars is null."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(_own(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id; of rows with equal id and text one. Texts without words are alone."""
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item; rows with equal id and text stay or go together."""
    own = docs.select(F.struct(*_own(docs)).alias("row"), "doc_id", "text").select("row", *doc_key())
    keyed = docs.select(*doc_key(), "text").select(F.struct("_k1", "_k2").alias("doc_id"), "text")
    found = decontaminate.contained(keyed, table(spark, sf_dir, "benchmark")).select("doc_id._k1", "doc_id._k2").distinct()
    return own.join(written(found, "contaminated"), ["_k1", "_k2"], "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to, as op2 gives them; a null text counts as empty."""
    return bpe_digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL expresses neither the classifier nor the encoder; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
