"""A column computed by numpy over Arrow batches, as an operator of its own that any plan can follow."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def with_batch_column(df: DataFrame, name: str, kind: T.DataType, run: Callable[..., pa.Array], *inputs: str) -> DataFrame:
    """``df`` with ``name``: ``run`` of the Arrow arrays of ``inputs``; a column of that name is replaced."""
    kept = [c for c in df.columns if c != name]

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], run(*[batch.column(c) for c in inputs])], names=[*kept, name])

    return df.mapInArrow(each, T.StructType([*[df.schema[c] for c in kept], T.StructField(name, kind)]))
