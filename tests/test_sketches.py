"""Sketches against sorted lists, merged by runs, tried again, and streamed."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwell.operators import sketches as S

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    values = lambda: rnd.choice([rnd.expovariate(0.02), -rnd.random() * 9, 0.0, 0.0004, 5e6 * rnd.random(), 7.0])
    out = [(rnd.choice("abc"), START + timedelta(minutes=rnd.randrange(4000)), values()) for _ in range(3000)]
    return out + [("a", None, 1.0), ("a", START, None), ("b", START, math.nan), (None, START, 3.5)]


SCHEMA = "k string, ts timestamp, value double"


def exact(values, p):
    return sorted(values)[round(p / 100 * (len(values) - 1))]


def test_error_is_bounded_in_each_window(spark, rows):
    got = S.quantiles(S.windows(S.sketched(spark.createDataFrame(rows, SCHEMA), ["k"]), ["k"]), ["k", "until"], [1, 50, 95, 99]).collect()
    clean = [r for r in rows if r[1] is not None and r[2] is not None and not math.isnan(r[2])]
    assert {r.k for r in got} == {"a", "b", "c", None} and len(got) > 200
    for r in got:
        own = [v for k, t, v in clean if k == r.k and r.until - timedelta(hours=24) <= t < r.until]
        assert r.n == len(own)
        for p in (1, 50, 95, 99):
            v = exact(own, p)
            assert abs(r[f"p{p}"] - v) < abs(v) / 64 + 1 / S.UNIT


def test_runs_merge_and_a_run_tried_again_counts_once(spark, rows, tmp_path):
    whole = sorted(map(tuple, S.sketched(spark.createDataFrame(rows, SCHEMA), ["k"]).collect()), key=repr)
    kept = S.Sketches(spark, str(tmp_path / "s"), ["k"])
    for i in (0, 1, 2, 1):
        kept.add(spark.createDataFrame(rows[i::3], SCHEMA), i)
    assert sorted(map(tuple, kept.read().collect()), key=repr) == whole
    at = tmp_path / "in"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(at))
    streamed = S.Sketches(spark, str(tmp_path / "t"), ["k"])
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(at))
    streamed.stream(log, str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, streamed.read().collect()), key=repr) == whole


def test_rows_of_a_sketch_do_not_grow_with_the_log(spark):
    log = spark.range(200_000).select(F.lit("a").alias("k"), F.lit(START).alias("ts"), (F.col("id") % 100_003 / 7.0).alias("value"))
    assert S.sketched(log, ["k"]).count() < 64 * 24 and S.sketched(log.limit(0), ["k"]).count() == 0
    assert S.breaches(S.quantiles(S.merged(S.sketched(log, ["k"]), ["k"]), ["k"], [50]), {"p50": 1.0}).count() == 1
