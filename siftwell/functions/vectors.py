"""Vector arithmetic as column expressions, in double precision; half precision, keys and principal components."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector has no length or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def l2_normalise(v: Column) -> Column:
    n = norm(v)
    return F.transform(_d(v), lambda x: x / F.when(n > 0, n).otherwise(1.0))


def int8(v: Column, scale: Column) -> Column:
    """Components times scale, cut toward zero."""
    return F.transform(_d(v), lambda x: (x * scale).cast("tinyint"))


def abs_max(v: Column) -> Column:
    return F.array_max(F.transform(_d(v), F.abs))


def float16(v: Column) -> Column:
    """Components rounded to half precision; values beyond its range become infinite."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return run(v)


def key(v: Column) -> Column:
    """A cache key of a vector: md5 of its components, rounded to six places, as JSON."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.md5(json.dumps([round(float(y), 6) for y in x]).encode()).hexdigest())

    return run(v)


def reduced(df: DataFrame, size: int, vector: str = "embedding", name: str = "reduced") -> DataFrame:
    """df with its vectors' first principal components about their mean, filled up with zeros to size.

    Means and components are sums over all rows; the driver gets a matrix of the square of a vector's length.
    """
    own = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    wide = df.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).first()[0] or 0
    k = min(size, wide)
    if not k:
        return df.withColumn(name, F.array_repeat(F.lit(0.0), size))
    centred = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(own).transform(own)
    out = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred).transform(centred)
    return out.select(*df.columns, F.concat(vector_to_array("__p"), F.array_repeat(F.lit(0.0), size - k)).alias(name))
