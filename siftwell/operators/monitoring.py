"""Summaries of logs (event_type, value, ts): latency, failures, buckets, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the histogram.
BUCKETS = [0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0]


def nearest_rank(log: DataFrame, value: str, percents: list[int], by: list[str]) -> DataFrame:
    """Values at round-half-even(p / 100 * (n - 1)) in order, exactly, for each group.

    Equal values are counted first; counts of slices of the value range (a 64th of an octave) tell which slices
    hold the ranks, and only these are ordered, so neither a list nor an order of all values is made.
    """
    per = log.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    per = per.withColumn("_s", F.floor(F.log2(F.abs(F.col(value)) + 1e-9) * 64) * 2 + F.when(F.col(value) < 0, 1).otherwise(0))
    slices = per.groupBy(*by, "_s").agg(F.sum("_n").alias("_sn"), F.min(value).alias("_lo"))
    w = Window.partitionBy(*by)
    slices = slices.withColumn("_before", F.sum("_sn").over(w.orderBy("_lo")) - F.col("_sn")).withColumn("_all", F.sum("_sn").over(w)).drop("_lo")
    at = lambda p: F.greatest(F.bround(F.lit(p / 100) * (F.col("_all") - 1)), F.lit(0.0))
    holds = reduce(Column.__or__, [(F.col("_before") <= at(p)) & (at(p) < F.col("_before") + F.col("_sn")) for p in percents])
    ranked = per.join(slices.where(holds), [*by, "_s"]).withColumn("_hi", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_s").orderBy(value)))
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("_hi") > at(p), F.col(value))).alias(f"p{p}") for p in percents])


def summary(log: DataFrame, failed: Column, percents: list[int], by: list[str]) -> DataFrame:
    """Counts, mean and nearest-rank percentiles of value by group."""
    agg = log.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("failed"), F.round(F.avg("value"), 6).alias("avg_value"))
    return agg.join(nearest_rank(log, "value", percents, by), by)


def series(log: DataFrame, width: str = "1 hour", value: str = "value") -> DataFrame:
    """(bucket, total, mean, n) for buckets with rows."""
    return log.groupBy(F.window(F.col("ts").cast("timestamp"), width).start.alias("bucket")).agg(F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))


def rolling(log: DataFrame, width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    return log.groupBy(F.window(F.col("ts").cast("timestamp"), width, slide).end.alias("until")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def histogram(log: DataFrame, by: list[str], bounds: list[float] = BUCKETS) -> DataFrame:
    """Cumulative counts by upper bound."""
    return log.groupBy(*by).agg(*[F.count_if(F.col("value") <= b).alias("le_" + str(b).replace(".", "_")) for b in bounds], F.count("*").alias("n"))


def alerts(values: DataFrame, rules: list[tuple[str, str, str, float]], by: list[str] | None = None) -> DataFrame:
    """(by, name, severity, value, threshold) of rules (metric, over or under, severity, threshold) that a row of values breaks."""
    made = [F.struct(F.lit(m).alias("name"), F.lit(s).alias("severity"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.lit(how == "over").alias("over")) for m, how, s, t in rules]
    rows = values.select(*(by or []), F.explode(F.array(*made)).alias("x")).select(*(by or []), "x.*")
    return rows.where(F.when(F.col("over"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))).drop("over")


def ingestion_summary(runs: DataFrame) -> DataFrame:
    """One row of runs (documents, chunks, duration, errors, ts): their number, sums, mean duration and last time; zeros without runs."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return runs.agg(F.count("*").alias("runs"), total("documents"), total("chunks"), F.round(F.coalesce(F.avg("duration"), F.lit(0.0)), 6).alias("avg_duration"), F.max("ts").alias("last_run"), total("errors"))


def by_component(log: DataFrame, component: str, failed: Column, error: Column, order: Column, value: str = "value") -> DataFrame:
    """(component, calls, errors, mean, last_error): the error of the last failing row in order, null if none failed."""
    last = F.max_by(F.when(failed, error), F.when(failed, order))
    return log.groupBy(component).agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors"), F.round(F.avg(value), 6).alias("mean"), last.alias("last_error"))


def metric_rows(log: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(metric, value, and log's columns): a row for each metric (its value, and when it is recorded) of each row."""
    made = [F.when(when, F.struct(F.lit(name).alias("metric"), value.cast("double").alias("metric_value"))) for name, (value, when) in metrics.items()]
    return log.withColumn("_m", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull()))).select(*log.columns, "_m.*")


def hit_rates(lookups: DataFrame, by: str) -> DataFrame:
    """(by, hits, misses, rate) of lookups (hit boolean)."""
    return lookups.groupBy(by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.count_if("hit") / F.count("*"), 6).alias("rate"))


#: Severities, the worst last.
STATUSES = ["healthy", "degraded", "unhealthy"]


def health(components: DataFrame, share: Column, degraded: float, unhealthy: float) -> DataFrame:
    """components with status by their share of failures, and overall the worst of all."""
    code = F.when(share >= unhealthy, 2).when(share >= degraded, 1).otherwise(0)
    name = lambda c: F.element_at(F.array(*map(F.lit, STATUSES)), c + 1)
    worst = components.agg(F.max(code).alias("_w"))  # one row
    return components.join(F.broadcast(worst)).withColumn("status", name(code)).withColumn("overall", name(F.col("_w"))).drop("_w")
