"""Samples from tables of vectors, and from memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..schemas import SAMPLES

SCALE = 510.0


def pixel_of(value: Column) -> Column:
    """A vector's component as a pixel: clamp(floor(510 x), 0, 255)."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(value.cast("double") * SCALE).cast("int")))


def vector_samples(vectors: DataFrame, rows: int = 8, columns: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Samples of a table of unit vectors, read row-major as rows x columns images.

    Stand-in data: the labels need not be learnable from the pixels.
    """
    return vectors.select(F.col(id_col).cast("bigint").alias("idx"), F.lit(rows).alias("rows"), F.lit(columns).alias("columns"), F.transform(vector_col, pixel_of).alias("pixels"), F.col(label_col).cast("int").alias("label"))


def enlarge(samples: DataFrame, rows: int, columns: int, side: int = 28) -> DataFrame:
    """Samples of rows x columns brought to side x side by the nearest pixel."""
    source = F.array(*[F.lit(r * rows // side * columns + c * columns // side) for r in range(side) for c in range(side)])
    return samples.withColumns({"pixels": let(F.col("pixels"), lambda pixels: F.transform(source, lambda i: F.get(pixels, i))), "rows": F.lit(side), "columns": F.lit(side)})


def memory_samples(spark: SparkSession, images: list[list[int]], labels: list[int], rows: int, columns: int) -> DataFrame:
    """Samples from Python lists; raises unless images and labels match in number and the images in size."""
    if len(images) != len(labels):
        raise ValueError("image and label counts differ")
    if rows < 1 or columns < 1 or any(len(image) != rows * columns for image in images):
        raise ValueError("image dimensions do not match its pixel data")
    return spark.createDataFrame([(i, rows, columns, list(image), label) for i, (image, label) in enumerate(zip(images, labels))], SAMPLES)
