"""CSV, JSON and XML files as typed records; what doesn't fit the types is kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siftwell.store import written

#: Options by format: quoted fields may hold line breaks, and white space in fields is data.
OPTIONS = {
    "csv": {"header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
    "json": {},
    "xml": {"rowTag": "row", "ignoreSurroundingSpaces": "false"},
}


def _reader(spark: SparkSession, kind: str, options: dict[str, str]):
    if kind not in OPTIONS:
        raise ValueError(f"no records in files of type {kind}")
    return spark.read.format(kind).options(**(OPTIONS[kind] | options))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def inferred(spark: SparkSession, paths: str | list[str], kind: str, options: dict[str, str] | None = None) -> StructType:
    """The schema that all records of the files fit; records that can't be read at all don't count."""
    more = {} if kind == "csv" else {"columnNameOfCorruptRecord": "_unreadable"}
    found = _reader(spark, kind, (options or {}) | {"inferSchema": "true"} | more).load(paths).schema
    return StructType([f for f in found.fields if f.name != "_unreadable"])


def records(
    spark: SparkSession, paths: str | list[str], kind: str, schema: StructType | str | None = None, options: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records of schema, (path, record) of those that don't fit it); each file is parsed once, apart from inferring a schema that isn't given.

    A CSV line of more or fewer fields, a value of another type, JSON or XML that doesn't parse: such a record is among the second, as it stands.
    Types that are inferred fit all readable records, so a stray word makes a column of numbers one of strings; give the schema to keep it aside.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    schema = schema or inferred(spark, paths, kind, options)
    bad = _free("record", schema.names)
    path = _free("path", [*schema.names, bad])
    full = StructType([*[StructField(f.name, f.dataType) for f in schema.fields], StructField(bad, StringType())])
    rows = _reader(spark, kind, (options or {}) | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).schema(full).load(paths)
    # Both tables come from one written, as Spark refuses a scan of the unfit records alone.
    own = written(rows.withColumn(path, F.col("_metadata.file_path")), f"records-{kind}")
    good = own.where(F.col(f"`{bad}`").isNull()).select(*[F.col(f"`{n}`") for n in schema.names])
    return good, own.where(F.col(f"`{bad}`").isNotNull()).select(F.col(f"`{path}`").alias("path"), F.col(f"`{bad}`").alias("record"))
