import os
import time

import pytest
from pyspark.sql import functions as F

from siftwell.operators.dedup import exact
from siftwell.operators.ingestion import Ingestion, Registry, Run
from siftwell.sources import files as S
from siftwell.streaming import events


def put(folder, **texts):
    for name, t in texts.items():
        (folder / f"{name}.txt").write_text(t)


def listed(spark, folder):
    return S.scan(spark, str(folder), ("*.txt",)).withColumnRenamed("modificationTime", "mtime")


def process(files):
    return files.select("path", F.explode(F.split(S.decoded(F.col("content")), "\n")).alias("line"))


def lines(ingestion):
    return sorted((os.path.basename(r.path)[:-4], r.line) for r in ingestion.table().collect())


def test_a_failed_run_is_taken_up_again(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, a="one\ntwo", b="three")
    ingestion = Ingestion(spark, str(tmp_path / "state"))
    assert ingestion.table() is None

    def broken(files):
        return process(files).withColumn("line", F.when(F.col("line") == "two", F.raise_error(F.lit("broken"))).otherwise(F.col("line")))

    with pytest.raises(Exception, match="broken"):
        ingestion.run(listed(spark, folder), broken)
    assert ingestion.table() is None and ingestion.state().count() == 0
    with monkeypatch.context() as m, pytest.raises(RuntimeError):  # rows are stored, but the run isn't committed
        m.setattr(Ingestion, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        ingestion.run(listed(spark, folder), process)
    assert ingestion.table() is None
    assert ingestion.run(listed(spark, folder), process) == Run(2, 2)
    assert lines(ingestion) == [("a", "one"), ("a", "two"), ("b", "three")]
    assert ingestion.run(listed(spark, folder), process) == Run()

    time.sleep(1.1)
    put(folder, b="four\nfive", c="six")
    assert ingestion.run(listed(spark, folder), process, batch=7) == Run(2, 2)
    assert lines(ingestion) == [("a", "one"), ("a", "two"), ("b", "five"), ("b", "four"), ("c", "six")]
    time.sleep(1.1)
    put(folder, a="seven")
    assert ingestion.run(listed(spark, folder), process, batch=7) == Run(), "a committed batch is never run again"
    before = lines(ingestion)
    ingestion.compact()
    assert lines(ingestion) == before and ingestion.run(listed(spark, folder), process, batch=7) == Run()
    assert ingestion.run(listed(spark, folder), process, batch=8) == Run(1, 1)
    assert lines(ingestion)[0] == ("a", "seven") and len(lines(ingestion)) == 4


def test_two_runs_at_once_cannot_both_commit(spark, tmp_path):
    ingestion = Ingestion(spark, str(tmp_path / "state"))
    files = spark.createDataFrame([("x.txt", 1)], "path string, n int").withColumn("mtime", F.timestamp_seconds("n"))

    def meanwhile(own):
        Ingestion(spark, str(tmp_path / "state")).run(files, lambda d: d.select("path"))
        return own.select("path")

    with pytest.raises(RuntimeError, match="moved on"):
        ingestion.run(files, meanwhile)
    assert ingestion.table().count() == 1


def test_stream_replays_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.txt", i) for i in range(5)], "path string, n int").withColumn("mtime", F.timestamp_seconds("n"))
    rows.write.parquet(str(tmp_path / "lists"))
    ingestion = Ingestion(spark, str(tmp_path / "state"))
    each = ingestion.each(lambda d: d.select("path", "n"))
    for checkpoint in ("one", "two"):  # the second has lost the checkpoint and starts at batch 0 again
        events.incremental(spark, str(tmp_path / "lists"), rows.schema, str(tmp_path / checkpoint), each)
    assert ingestion.table().count() == 5 and len(ingestion.versions.read().collect()) == 1


def test_three_runs_equal_one(spark, tmp_path):
    texts = [(i, f"text {i % 37 if i % 3 else i}" + ("  " if i % 2 else "")) for i in range(300)] + [(300, None), (301, ""), (None, "text 5"), (None, "new"), (302, "new")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, _g string")
    registry = Registry(spark, str(tmp_path / "r"), buckets=4)
    parts = [F.col("doc_id") < 100, (F.col("doc_id") >= 100) & (F.col("doc_id") < 200), F.coalesce(F.col("doc_id") >= 200, F.lit(True))]
    got = [registry.admit(df.where(p)) for p in parts]
    assert got[0].columns == df.columns
    want = sorted(r.doc_id for r in exact(df.drop("_g")).collect())
    assert sorted(r.doc_id for g in got for r in g.collect()) == want
    again = registry.admit(df.where(parts[1]))
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in got[1].collect()), "a repeated run finds its own rows"
    assert registry.admit(df.limit(0)).count() == 0
    late = registry.admit(spark.createDataFrame([(900, "text 1", ""), (901, "brand new", "")], df.schema))
    assert [r.doc_id for r in late.collect()] == [901]
