"""Quantile sketches that merge: counts of slices of the value range for each group and time bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a unit that values are told apart by.
UNIT = 1000
#: Binary digits of a value that its slice keeps; a slice's edge is within 1/64 of the values in it, and within one part of a unit.
DIGITS = 7


def slice_of(value: Column) -> Column:
    """The lower edge of a value's slice in parts of a unit, nearer to zero for negative values; null for nulls and NaN."""
    parts = F.floor(F.abs(value) * UNIT).cast("long")
    spare = F.greatest(F.char_length(F.bin(parts)) - DIGITS, F.lit(0))
    edge = F.call_function("shiftleft", F.call_function("shiftright", parts, spare), spare)
    return F.when(value.isNotNull() & ~F.isnan(value), F.when(value < 0, -edge).otherwise(edge))


def sketched(log: DataFrame, by: list[str], value: str = "value", ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """(by, bucket, slice, n): the sketch of each group and bucket, whose rows don't grow with the log's (128 slices an octave at most).

    Rows without a value, NaN or a time are left out; batch and stream alike, as it is one partial aggregate.
    """
    rows = log.select(*by, F.window(F.col(ts).cast("timestamp"), width).start.alias("bucket"), slice_of(F.col(value).cast("double")).alias("slice"))
    return rows.where("slice IS NOT NULL AND bucket IS NOT NULL").groupBy(*by, "bucket", "slice").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, slice, n): the sketch of all rows that sketches of the same groups were made of."""
    return sketches.groupBy(*by, "slice").agg(F.sum("n").alias("n"))


def windows(sketches: DataFrame, by: list[str], hours: int = 24) -> DataFrame:
    """(by, until, slice, n): sketches of hours merged into windows of so many hours that end at each full hour.

    Hours are counted into the windows they belong to, never the log's rows.
    """
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(hours)), lambda h: F.col("bucket") + F.make_dt_interval(hours=h)))
    return merged(sketches.withColumn("until", ends), [*by, "until"])


def quantiles(sketch: DataFrame, by: list[str], percents: list[int]) -> DataFrame:
    """(by, n, p...): the edge of the slice that holds the nearest rank, round-half-even(p / 100 * (n - 1)).

    The exact value v of that rank is off by less than |v| / 64 + 1 / UNIT. A group's order is over its slices, of which there are few.
    """
    w = Window.partitionBy(*by)
    own = sketch.withColumn("_hi", F.sum("n").over(w.orderBy("slice"))).withColumn("_all", F.sum("n").over(w))
    at = lambda p: F.greatest(F.bround(F.lit(p / 100) * (F.col("_all") - 1)), F.lit(0.0))
    edges = [(F.min(F.when(F.col("_hi") > at(p), F.col("slice"))) / UNIT).alias(f"p{p}") for p in percents]
    return own.groupBy(*by).agg(F.max("_all").alias("n"), *edges)


class Sketches:
    """Sketches of runs below a path that all executors share; a run of a known number takes the place of its earlier try."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], width: str = "1 hour"):
        self.spark, self.path, self.by, self.width = spark, path.rstrip("/"), by, width

    def add(self, log: DataFrame, run: int) -> None:
        """Store the sketch of a run; with foreachBatch, run is the number of the batch, so that one tried again counts once."""
        sketched(log, self.by, width=self.width).write.mode("overwrite").parquet(f"{self.path}/run={int(run)}")

    def read(self) -> DataFrame:
        """(by, bucket, slice, n) over all runs."""
        rows = self.spark.read.parquet(self.path)
        return rows.groupBy(*self.by, "bucket", "slice").agg(F.sum("n").alias("n"))

    def stream(self, log: DataFrame, checkpoint: str):
        """A started query that adds each batch of a streamed log; late rows count like any other, as sums don't close."""
        return log.writeStream.foreachBatch(lambda rows, i: self.add(rows, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaches(values: DataFrame, over: dict[str, float]) -> DataFrame:
    """Rows of quantiles with any column over its threshold."""
    return values.where(reduce(Column.__or__, [F.col(c) > t for c, t in over.items()]))
