"""A bitmap of bounded size in front of a join: most rows that cannot meet stay where they are."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import U64, mix

#: Bits for each id, and at most; with more ids than MOST_BITS / EACH there is no filter and the join alone decides.
EACH, MOST_BITS = 32, 1 << 26


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values.astype(np.int64).view(U64)) & U64(bits - 1)).astype(np.int64)


@dataclass
class Near:
    """A test that is false only for values that are not among the ids: of bigint columns, and of arrays on executors."""

    bitmap: Broadcast

    def test(self, values: np.ndarray) -> np.ndarray:
        bitmap = self.bitmap.value
        at = _slots(values, 64 * len(bitmap))
        return (bitmap[at >> 6] >> (at & 63)) & 1 > 0

    def __call__(self, value: Column) -> Column:
        return F.arrow_udf(lambda v: pa.array(self.test(v.to_numpy(zero_copy_only=False))), T.BooleanType())(value)


def maybe_in(ids: DataFrame) -> Near | None:
    """Of the one column (bigint, no nulls) of ``ids``, a written table; None where there are too many ids.

    The bits are or-ed in Spark and sized by the number of ids; what reaches the driver is at most MOST_BITS.
    """
    n = ids.count()
    if n * EACH > MOST_BITS:
        return None
    bits = max(1 << 12, 1 << (n * EACH).bit_length())

    def run(batches):
        for batch in batches:
            at = _slots(batch.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((U64(1) << (at & 63).astype(U64)).view(np.int64))], names=["w", "b"])

    words = ids.mapInArrow(run, "w int, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return Near(ids.sparkSession.sparkContext.broadcast(bitmap))
