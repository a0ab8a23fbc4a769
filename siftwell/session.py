"""Session settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch that a Python task gets, but for its last row. Spark's own bound is 64 MB, of which a task makes Python strings, results and their batch.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hold batches to BATCH_BYTES, whatever rows weigh (long texts, blocks of vectors); a session that has less keeps it."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings stay where they are given."""
    b = (
        SparkSession.builder.appName("siftwell")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master or "SPARK_MASTER" not in os.environ:
        b = b.master(master or "local[*]")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    bound_batches(spark)
    return spark
