"""Events and predictions over streams of samples. The original has no streams; these reuse the batch plans as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import encode_images
from ..operators.match import match_batches


def predict_stream(samples: DataFrame, protos: DataFrame, rows: int, columns: int, multiplier: float = 1.3) -> DataFrame:
    """A streaming ``samples`` (with ``at``, an event time) with predicted and score: stateless, without a shuffle."""
    return match_batches(encode_images(samples, rows, columns, multiplier), protos).drop("pixels", "event")


def windowed_accuracy(preds: DataFrame, at: str = "at", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """correct and total by window of event time; rows later than ``late`` are dropped by the watermark."""
    grouped = preds.withWatermark(at, late).groupBy(F.window(at, window).alias("window"))
    return grouped.agg(F.sum((F.col("predicted") == F.col("label")).cast("bigint")).alias("correct"), F.count("*").alias("total"))
