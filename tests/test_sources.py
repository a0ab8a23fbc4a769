"""Files in folders: scans, decoding, parsing, incremental runs, and the stores' refusals."""

import os

import pytest
from pyspark.sql import functions as F

from siftwell import store
from siftwell.operators import records
from siftwell.sources import files
from siftwell.streaming import events as S


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, raw in (("a.md", b"# T\nx"), ("b.TXT", "é".encode()), ("sub/c.md", b"caf\xe9 \xff"), ("sub/d.html", b"<p>x</p><script>y</script>"), ("e", b"z"), ("empty", b"")):
        (tmp_path / name).write_bytes(raw)
    return tmp_path


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_scans(spark, folder):
    assert names(files.scan(spark, str(folder))) == ["a.md", "b.TXT", "c.md", "d.html", "e"]
    assert names(files.scan(spark, str(folder), ("*.md",), recursive=False)) == ["a.md"]
    assert names(files.scan(spark, str(folder), ("*.md", "a*", "*.html"))) == ["a.md", "c.md", "d.html"]
    kinds = {os.path.basename(r.path): r.file_type for r in files.loader("local")(spark, str(folder)).collect()}
    assert kinds == {"a.md": "md", "b.TXT": "txt", "c.md": "md", "d.html": "html", "e": "unknown"}
    with pytest.raises(ValueError):
        files.loader("remote")


def test_decoding_and_parsing(spark, folder):
    own = files.scan(spark, str(folder))
    got = {os.path.basename(r.path): r for r in files.parsed(own).withColumn("dropped", files.without_bad_bytes(F.col("content"))).collect()}
    assert got["c.md"].text == "café ÿ" and got["c.md"].dropped == "caf " and got["b.TXT"].text == "é" == got["b.TXT"].dropped
    assert (got["d.html"].parser, got["d.html"].text) == ("html", "x") and got["e"].text == "z" and got["a.md"].parser == "markdown"
    with pytest.raises(ValueError):
        files.table_as(F.array(), "vision")


def test_a_run_commits_only_what_was_stored(spark):
    files_ = spark.createDataFrame([("a", 5), ("b", 5), ("c", None), ("d", 1)], "path string, mtime long")
    state = spark.createDataFrame([("b", 4), ("d", 1)], "path string, mtime long")
    pending = records.pending(files_, state)
    assert sorted(r.path for r in pending.collect()) == ["a", "b", "c"]
    after = records.committed(state, pending, spark.createDataFrame([("a",), ("a",)], "path string"))
    assert sorted(map(tuple, after.collect())) == [("a", 5), ("b", 4), ("d", 1)]
    assert sorted(r.path for r in records.pending(files_, after).collect()) == ["b", "c"]


def test_incremental_folder(spark, tmp_path):
    at, done = str(tmp_path / "in"), []
    each = lambda batch, _: done.extend(r.x for r in batch.collect())
    for x in (1, 2):
        spark.range(1).select(F.lit(x).alias("x")).write.mode("append").parquet(at)
        S.incremental(spark, at, "x int", str(tmp_path / "checkpoint"), each)
    assert done == [1, 2]


def test_sessions_and_rolling_streams(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200)
    log.write.parquet(str(tmp_path / "log"))
    stream = lambda: S.read(spark, str(tmp_path / "log"), log.schema)
    for name, made, window in (("sessions", S.sessions(stream()), F.session_window("ts", "30 minutes")), ("rolled", S.rolling(stream()), F.window("ts", "24 hours", "1 hour"))):
        made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
        by = ["user_id"] if name == "sessions" else []
        want = log.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(*by, window.alias("w")).agg(F.count("*").alias("n")).select(*by, "w.start", "n")
        got = spark.table(name).select(*by, "start", "n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chunks_without_a_vector_stop_the_job(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "id long, embedding array<double>")
    with pytest.raises(Exception, match="no embedding"):
        records.embedded(df).collect()


def test_tables_between_steps_can_be_cleared(spark):
    folder = store.shared_dir(spark).removeprefix("file://")
    store.written(spark.range(3).toDF("x"), "some")
    assert os.path.isdir(folder)
    kept = folder + "-kept"
    os.rename(folder, kept)  # other tests' tables stay
    store.written(spark.range(3).toDF("x"), "some")
    store.clear(spark)
    assert not os.path.exists(folder)
    os.rename(kept, folder)
