"""Columns computed from a text column by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftwell.llm import _kernel as K


def with_columns(
    df: DataFrame,
    text: str,
    fields: list[StructField],
    fn: Callable[[pa.ChunkedArray | pa.Array], list[pa.Array]],
    keep: list[str] | None = None,
    limit: int = K.SLICE_BYTES,
    beside: tuple[str, ...] = (),
) -> DataFrame:
    """df (its columns keep, or all) with fields computed by fn from runs of the text column.

    fn gets at most about limit bytes of text at a time. A column that has the name of a new one, in any
    case of letters, is replaced. The columns beside are passed on to fn after the text.
    """
    new = {f.name.lower() for f in fields}
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    # mapInArrow takes no names with dots, so columns go by number.
    taken = [*stay, *beside, text]
    source = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(taken)])
    n = len(stay)
    names = [*stay, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo, hi in _runs(texts, limit):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *fn(part.column(part.num_columns - 1), *part.columns[n:-1])], names)

    own = [StructField(c, f.dataType, f.nullable) for c, f in zip(stay, source.schema.fields)]
    schema = StructType(own + fields)
    return source.mapInArrow(run, schema)


def _runs(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    for s in K.slices(texts, limit):
        yield s.lo, s.hi
