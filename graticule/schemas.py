"""Schemas of the engine's tables and the catalogue of splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PIXELS = T.ArrayType(T.IntegerType())
EVENT = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
SAMPLES = "idx bigint, rows int, columns int, pixels array<int>, label int"
PROTOTYPES = "label int, expert int, channel int, slot int, lo bigint, hi bigint, weight float"
CONFUSION = "actual int, predicted int, n bigint"
EPOCHS = "epoch int, loss double, accuracy double, seconds double"

#: A payload of 96 bits is two words of 48, which keeps every value clear of the sign bit.
PAYLOAD = 96
WORD = 48


@dataclass(frozen=True)
class Split:
    """A partition of the character data: classes and the label of the first one."""

    name: str
    classes: int
    offset: int = 0


#: The standard splits.
SPLITS = (Split("byclass", 62), Split("bymerge", 47), Split("balanced", 47), Split("letters", 26, 1), Split("digits", 10), Split("mnist", 10))


def find_split(name: str) -> Split:
    """The split of exactly this name; raises ValueError for any other."""
    for split in SPLITS:
        if split.name == name:
            return split
    raise ValueError(f"unknown split: {name}")


def split_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, s.classes, s.offset) for s in SPLITS], "name string, class_count int, label_offset int")
