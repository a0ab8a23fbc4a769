"""Runs over changing files, and duplicates across runs: state that counts only once what it stands for is stored."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.dedup import fingerprint
from siftwell.operators.graph import by_size, stored
from siftwell.operators.records import pending
from siftwell.store import Versions, written


@dataclass
class Run:
    """Files that were new or changed, and those of them of which rows were stored; nothing for a batch that had been committed before."""

    pending: int = 0
    stored: int = 0


class Ingestion:
    """Rows of files below path, which the driver and all executors share.

    A run takes the files (path, mtime, ...) that are new or newer than what the committed state has, makes rows (path, ...) of them, and writes these and the
    state's change beside earlier ones; then one new version of a small table of runs makes both count. A run that fails anywhere before leaves nothing that counts, so the next one
    takes its files again, and a batch id that has been committed is not run again, so replays by a stream repeat nothing. A changed file's rows take
    the place of its earlier ones. Files of which no row is stored (as duplicates) aren't committed and come again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/runs", "name string, place long, batch long")

    def _all(self, table: str, runs: list) -> DataFrame | None:
        out = None
        for r in runs:
            own = self.spark.read.parquet(f"{self.path}/{r.name}/{table}").withColumn("_run", F.lit(r.place))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def _runs(self) -> tuple[int, list]:
        version = self.versions.latest()
        return version, self.versions.read(version).orderBy("place").collect()  # a row a run

    def state(self, runs: list | None = None) -> DataFrame:
        """(path, mtime, run) of the last committed run of each file."""
        files = self._all("files", self._runs()[1] if runs is None else runs)
        if files is None:
            return self.spark.createDataFrame([], "path string, mtime timestamp, run long")
        return files.groupBy("path").agg(F.max_by("mtime", "_run").alias("mtime"), F.max("_run").alias("run"))

    def table(self) -> DataFrame | None:
        """The rows of each file's last run; None before the first run."""
        _, runs = self._runs()
        rows = self._all("rows", runs)
        if rows is None:
            return None
        last = self.state(runs).select("path", F.col("run").alias("_run"))
        return rows.join(last, ["path", "_run"], "left_semi").drop("_run")

    def run(self, files: DataFrame, process: Callable[[DataFrame], DataFrame], batch: int | None = None) -> Run:
        """Store process(files that are pending) and commit them."""
        version, runs = self._runs()
        if batch is not None and any(r.batch == batch for r in runs):
            return Run()
        own, n = stored(pending(files, self.state(runs).select("path", "mtime")), "pending")
        if not n:
            return Run()
        name = f"run-{uuid.uuid4().hex}"
        process(own).write.parquet(f"{self.path}/{name}/rows")
        done = self.spark.read.parquet(f"{self.path}/{name}/rows").select("path").distinct()
        own.join(done, "path", "left_semi").select("path", "mtime").write.parquet(f"{self.path}/{name}/files")
        place = max((r.place for r in runs), default=0) + 1
        self._commit([*map(tuple, runs), (name, place, batch)], version)
        return Run(n, self.spark.read.parquet(f"{self.path}/{name}/files").count())

    def compact(self) -> None:
        """One run of what counts now; the ids of batches stay known."""
        version, runs = self._runs()
        if len(runs) < 2:
            return
        name = f"run-{uuid.uuid4().hex}"
        self.table().write.parquet(f"{self.path}/{name}/rows")
        self.state(runs).select("path", "mtime").write.parquet(f"{self.path}/{name}/files")
        empty = f"run-{uuid.uuid4().hex}"
        for t in ("rows", "files"):
            self.spark.read.parquet(f"{self.path}/{name}/{t}").limit(0).write.parquet(f"{self.path}/{empty}/{t}")
        batches = [(empty, 0, r.batch) for r in runs if r.batch is not None]
        self._commit([(name, runs[-1].place, None), *batches], version)

    def _commit(self, rows: list, version: int) -> None:
        self.versions.commit(self.spark.createDataFrame(rows, "name string, place long, batch long").coalesce(1), version)

    def each(self, process: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream of files (path, mtime, ...)."""

        def one(files: DataFrame, batch: int) -> None:
            self.run(files, process, batch)

        return one


class Registry:
    """Fingerprints of all texts that earlier runs have kept, in buckets with a filter each, below a path that all share.

    A text is a duplicate if its fingerprint stands under another id, in an earlier run or with a lesser id in its own; the same id comes through again, so a run that is repeated
    after a crash finds its own rows. The filters (bitmaps, 12 bits a fingerprint and four places) rule most new texts out; only what is left meets the table of fingerprints, so a run reads
    filters and shuffles its own fingerprints, not those of all runs. Work in a bucket is bounded by its share of a run: give more buckets to larger runs.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.versions = Versions(spark, f"{self.path}/state", "name string")

    def _tables(self, table: str, names: list[str]) -> DataFrame | None:
        own = [self.spark.read.parquet(f"{self.path}/{n}/{table}") for n in names]
        return reduce(DataFrame.unionByName, own) if own else None

    def admit(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of docs that are no duplicates; their fingerprints are registered. Of rows of one id and fingerprint all or none come through."""
        version = self.versions.latest()
        names = [r.name for r in self.versions.read(version).collect()]
        # Columns of any name pass through in one value.
        own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("own"), fingerprint(F.col(f"`{text}`")).alias("_f"))
        order = F.struct(F.col("own").isNull().alias("n"), F.col("own").alias("id"))
        bucket = F.pmod(F.xxhash64("_f"), F.lit(self.buckets)).cast("int")
        first = written(own.groupBy("_f").agg(F.min(order).alias("o")).select("_f", F.col("o.id").alias("id"), bucket.alias("bucket")), "first")
        known = self._known(first.select("_f", "bucket"), names)
        if known is not None:
            known, n = stored(known, "known")
            fresh = written(first.join(by_size(known.select("_f"), n), "_f", "left_anti"), "fresh")
            taken = known.select("_f", "id")
        else:
            fresh, taken = first, first.select("_f", "id").limit(0)
        name = f"prints-{uuid.uuid4().hex}"
        fresh.repartition("bucket").sortWithinPartitions("bucket", "_f").write.partitionBy("bucket").parquet(f"{self.path}/{name}/prints")
        self._filters(fresh).write.parquet(f"{self.path}/{name}/filters")
        allowed = fresh.select("_f", "id").unionByName(taken).select(F.col("_f").alias("_g"), "id")
        out = written(own.join(allowed, (F.col("_f") == F.col("_g")) & F.col("own").eqNullSafe(F.col("id")), "left_semi").select("row.*"), "admitted")
        if not fresh.isEmpty():
            self.versions.commit(self.spark.createDataFrame([(n,) for n in [*names, name]], "name string").coalesce(1), version)
        return out

    def _known(self, rows: DataFrame, names: list[str]) -> DataFrame | None:
        """(_f, id) of the registered among rows (_f, bucket)."""
        filters, prints = self._tables("filters", names), self._tables("prints", names)
        if filters is None:
            return None
        asked = rows.select("bucket", F.lit(1).alias("turn"), "_f", F.xxhash64(F.lit(1), "_f").alias("x"), F.xxhash64(F.lit(2), "_f").alias("y"))
        both = asked.unionByName(filters.select("bucket", F.lit(0).alias("turn"), "bits"), allowMissingColumns=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for b in batches:
                bucket, turn = b.column("bucket").to_numpy(), b.column("turn").to_numpy()
                keep = np.zeros(b.num_rows, bool)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(bucket)]):
                    if lo == hi:
                        continue
                    if bucket[lo] != now:
                        now, held = bucket[lo], []  # the filters of one bucket at a time; they come before its rows
                    own = b.slice(lo, hi - lo)
                    first = int((turn[lo:hi] == 0).sum())
                    held += [np.frombuffer(x.as_py(), np.uint8) for x in own.column("bits").slice(0, first)]
                    x, y = (own.column(c).slice(first).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y"))
                    for bits in held:
                        keep[lo + first : hi] |= _there(bits, x, y)
                yield pa.RecordBatch.from_arrays([b.column("_f").filter(pa.array(keep)), b.column("bucket").filter(pa.array(keep))], ["_f", "bucket"])

        maybe, n = stored(both.repartition("bucket").sortWithinPartitions("bucket", "turn").mapInArrow(run, "_f string, bucket int"), "maybe")
        return prints.join(by_size(maybe, n), ["bucket", "_f"], "left_semi").select("_f", "id")

    def _filters(self, fresh: DataFrame) -> DataFrame:
        """(bucket, bits): a bitmap of a power of two of bytes for the fingerprints of each bucket."""
        rows = fresh.select("bucket", F.xxhash64(F.lit(1), "_f").alias("x"), F.xxhash64(F.lit(2), "_f").alias("y"))

        def made(t: pa.Table) -> pa.Table:
            size = max(64, 1 << int(np.ceil(np.log2(12 * t.num_rows))))
            bits = np.zeros(size, bool)
            for at in _places(t["x"].to_numpy().astype(np.int64), t["y"].to_numpy().astype(np.int64), size):
                bits[at] = True
            return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        return rows.groupBy("bucket").applyInArrow(made, "bucket int, bits binary")


def _places(x: np.ndarray, y: np.ndarray, size: int) -> Iterator[np.ndarray]:
    x, y = x.view(np.uint64), y.view(np.uint64)
    for i in range(4):
        yield ((x + np.uint64(i) * y) & np.uint64(size - 1)).astype(np.int64)


def _there(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at in _places(x, y, 8 * len(bits)):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
