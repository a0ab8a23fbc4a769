"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folders of local applications without spark.checkpoint.dir, by application id.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder of its machine; on a cluster it must be set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        at = _LOCAL[app]
    return f"{at.rstrip('/')}/siftwell-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove the tables that this application has written; results that still read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Versions:
    """Numbered versions of a small table below a path that all executors share; of each only whole ones count.

    A version is written as JSON beside the others and becomes the latest by its last step, the _SUCCESS file of Spark's writer, so what
    a crashed job has left is never read. Two writers can't both make the same version: the second finds its folder taken.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def latest(self) -> int:
        """The number of the latest whole version; 0 if there is none."""
        glob = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")
        found = glob.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(glob) or []
        return max((int(f.getPath().getParent().getName()[1:]) for f in found), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(f"{self.path}/v{version:09d}")

    def commit(self, df: DataFrame, after: int) -> int:
        """Make df the version that follows after; fails if someone else has done so."""
        if self.latest() != after:
            raise RuntimeError(f"{self.path} has moved on from version {after}")
        df.write.mode("errorifexists").json(f"{self.path}/v{after + 1:09d}")
        return after + 1
