"""Keyed records: last write wins, upserts, partial updates, deletes that cascade, conversations, an audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: a maximum by order, so only one row per task and key is shuffled."""
    rest = [c for c in log.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return log.groupBy(*key).agg(best).select(*key, "_r.*")


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with those of new (one a key) in the place of rows of their keys. Rows without a vector or key fail, as a store refuses them."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def embedded(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """chunks; a chunk without a vector stops the job."""
    return chunks.withColumn(vector, F.coalesce(F.col(vector), F.raise_error(F.lit("a chunk has no embedding"))))


def committed(state: DataFrame, files: DataFrame, done: DataFrame) -> DataFrame:
    """The state (path, mtime) after a run over files: those in done (path), which were stored, get their mtime; others stay as they were."""
    new = files.join(done.select("path").distinct(), "path", "left_semi").select("path", "mtime")
    return upsert(state.select("path", "mtime"), new, "path")


def bumped(parents: DataFrame, children: DataFrame, key: str, at: str = "updated_at") -> DataFrame:
    """parents with the time of their newest child, where that is later than their own."""
    newest = children.groupBy(key).agg(F.max(at).alias("_newest"))
    return parents.join(newest, key, "left").select(*[F.greatest(at, "_newest").alias(at) if c == at else F.col(c) for c in parents.columns])


def propagated(chunks: DataFrame, documents: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """chunks with the documents' fields where their own are null or missing."""
    own = [f for f in fields if f in chunks.columns]
    theirs = documents.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields])
    rest = [F.col(c) for c in chunks.columns if c not in own]
    return chunks.join(theirs, key, "left").select(*rest, *[F.coalesce(f, f"_d_{f}").alias(f) if f in own else F.col(f"_d_{f}").alias(f) for f in fields])


def audit_entries(log: DataFrame, query: Column, response: Column, keep_text: bool = False) -> DataFrame:
    """log with query_hash (sha256), query_text (only if kept), query_length and response_length."""
    q, r = F.coalesce(query, F.lit("")), F.coalesce(response, F.lit(""))
    text = q if keep_text else F.lit(None).cast("string")
    return log.withColumns({"query_hash": F.sha2(q, 256), "query_text": text, "query_length": F.char_length(q).cast("long"), "response_length": F.char_length(r).cast("long")})


def retained(log: DataFrame, now: Column, days: int, at: str = "ts") -> DataFrame:
    """Entries of the last days; 0 keeps all."""
    return log if days <= 0 else log.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def update(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the fields that changes has values for."""
    new = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def detach(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key is null where it was deleted."""
    out = rows.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return out.select(*[F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c == key else F.col(c) for c in rows.columns])


def pending(files: DataFrame, state: DataFrame) -> DataFrame:
    """files (path, mtime) that state (path, mtime) lacks, or that are newer; one without mtime always is."""
    old = state.select("path", F.col("mtime").alias("_old"))
    return files.join(old, "path", "left").where(F.col("_old").isNull() | F.col("mtime").isNull() | (F.col("mtime") > F.col("_old"))).drop("_old")


def auto_title(messages: DataFrame, size: int = 50) -> DataFrame:
    """(conv_id, title): the first user message; if longer than size, cut at its last space, with an ellipsis."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    head = F.substring("t", 1, size)
    return first.select("conv_id", F.when(F.char_length("t") <= size, F.col("t")).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("..."))).alias("title"))


def history(messages: DataFrame, n: int = 6) -> DataFrame:
    """Of the last n messages of a conversation those of user and assistant."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("back", F.row_number().over(w)).where((F.col("back") <= n) & F.col("role").isin("user", "assistant"))


def _of_bounded_size(rows: DataFrame, value: str, most: int) -> DataFrame:
    """rows without n; one of more than most parts stops the job, as it is one value of one task."""
    whole = F.when(F.col("n") > most, F.raise_error(F.lit("a conversation is too long for one value"))).otherwise(F.col(value))
    return rows.withColumn(value, whole).drop("n")


def export_markdown(messages: DataFrame, most: int = 100_000) -> DataFrame:
    """(conv_id, markdown): the messages of a conversation, of at most most, by turn."""
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit("**: "), F.coalesce("text", F.lit("")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x.l), "\n\n")
    return _of_bounded_size(messages.groupBy("conv_id").agg(F.count("*").alias("n"), text.alias("markdown")), "markdown", most)


def export_json(messages: DataFrame, most: int = 100_000) -> DataFrame:
    """(conv_id, json): the messages of a conversation, of at most most, by turn."""
    one = F.struct("turn", "role", "text")
    rows = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("json"))
    return _of_bounded_size(rows, "json", most)
