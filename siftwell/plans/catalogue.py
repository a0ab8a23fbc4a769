"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.session import bound_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under name, with its SQL twin where there is one."""

    def put(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("source_stats", "SELECT source, count(*) AS n_docs, sum(n_chars) AS total_chars FROM documents GROUP BY source")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("total_chars"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_context"](spark, sf_dir)


from siftwell.plans import feedback_queries, record_queries, retrieval_queries, text_queries  # noqa: E402, F401  (they register themselves)
