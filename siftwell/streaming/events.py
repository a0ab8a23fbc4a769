"""Event-time streams of logs: buckets, rolling windows, duplicates, limits, incremental files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.operators.ratelimit import Limiter


def read(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A stream of Parquet files with ts as an event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Totals by bucket; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.sum("value").alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "total", "n")


def rolling(stream: DataFrame, width: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return tumbling_over(stream, F.window("ts", width, slide), late)


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed by a gap (an extension)."""
    return tumbling_over(stream, F.session_window("ts", gap), late, ["user_id"])


def tumbling_over(stream: DataFrame, window, late: str, by: list[str] | None = None) -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(*(by or []), window.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(*(by or []), F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n", "mean")


def first_seen(stream: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """Rows whose key wasn't seen within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def limited(stream: DataFrame, per_minute: int, per_day: int, late: str = "2 hours") -> DataFrame:
    """(user_id, event_id, admitted) with a limiter's windows as state of each user; a trigger's rows count in the order of time.

    A user's state goes a day after their last event, when both windows have ended.
    """
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")).alias("user_id")
    own = stream.withWatermark("ts", late).select(user, "event_id", F.unix_micros("ts").alias("us"), "ts")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        m0, mn, d0, dn = state.get if state.exists else (None, 0, None, 0)
        limiter = Limiter(per_minute, per_day, ((m0, mn), (d0, dn)))
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
        rows["admitted"] = [limiter.admit(us / 1e6) for us in rows.us]
        (m0, mn), (d0, dn) = limiter.state
        state.update((m0, mn, d0, dn))
        state.setTimeoutTimestamp(max(int(rows.us.max() // 1000) + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield rows[["user_id", "event_id", "admitted"]]

    return own.groupBy("user_id").applyInPandasWithState(run, "user_id string, event_id long, admitted boolean", "m0 double, mn int, d0 double, dn int", "append", GroupStateTimeout.EventTimeTimeout)


def incremental(spark: SparkSession, folder: str, schema, checkpoint: str, each) -> None:
    """Run each(batch, batch_id) over files that the checkpoint hasn't seen, then stop."""
    spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
