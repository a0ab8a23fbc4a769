"""Streams give what the same rows give in a batch."""

from pyspark.sql import functions as F

from siftwell.operators import monitoring, ratelimit
from siftwell.streaming import events as S

SF = "/root/testdata/sf0.001"


def gathered(stream, spark, name, mode, folder):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/events.parquet").limit(300)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    stream = lambda: S.read(spark, str(tmp_path / "log"), log.schema)
    got = gathered(S.tumbling(stream()), spark, "tumbling", "complete", tmp_path)
    assert {(r.bucket, r.n) for r in got.collect()} == {(r.bucket, r.n) for r in monitoring.series(log).collect()}
    got = gathered(S.limited(stream(), 2, 8), spark, "limited", "append", tmp_path)
    want = ratelimit.decisions(log, 2, 8)
    assert {tuple(r) for r in got.select("user_id", "event_id", "admitted").collect()} == {tuple(r) for r in want.select("user_id", "event_id", "admitted").collect()}
    got = gathered(S.first_seen(stream(), ["user_id", "ts"]), spark, "first", "append", tmp_path)
    assert got.count() == log.select("user_id", F.col("ts").cast("timestamp")).distinct().count()
