"""Values bound once inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row.

    The optimizer inlines a column into the lambdas that use it, where it would be computed for every element.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))
