"""Matching events against prototype memories and picking winners.

Memories are bounded (at most 62 classes x 4 experts x 5 channels x 64 prototypes), and ``match`` checks that
before it broadcasts; larger ones must go through ``match_batches`` in blocks by the caller's choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import with_batch_column
from ..functions.similarity import similarity, similarity_np

MOST_PROTOTYPES = 100_000
CHANNELS = 5
PATCH_WEIGHT = 0.5


def bounded(protos: DataFrame) -> DataFrame:
    """``protos`` for broadcast, computed once; raises if there are more than MOST_PROTOTYPES."""
    found = protos.limit(MOST_PROTOTYPES + 1).toArrow()
    if found.num_rows > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prototypes are not broadcast")
    return F.broadcast(protos.sparkSession.createDataFrame(found, protos.schema))


def class_scores(events: DataFrame, protos: DataFrame, kind: str = "iou") -> DataFrame:
    """idx, label, score: the best prototype of each class. events: idx, lo, hi; protos: label, lo, hi, weight.

    Every event meets every prototype; the maximum forms before any shuffle.
    """
    p = bounded(protos.select("label", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "weight"))
    met = events.select("idx", "lo", "hi").crossJoin(p)
    score = similarity(F.col("lo"), F.col("hi"), F.col("p_lo"), F.col("p_hi"), kind) * F.col("weight").cast("double")
    return met.groupBy("idx", "label").agg(F.max(score).alias("score"))


def top_class(scores: DataFrame) -> DataFrame:
    """idx, predicted, score: the best class, the lowest label of equals; classes without a number score never win."""
    usable = F.when(~F.isnan("score") & (F.col("score") > -1), F.struct("score", (-F.col("label")).alias("k")))
    best = scores.groupBy("idx").agg(F.max(usable).alias("b"))
    return best.select("idx", F.coalesce(-F.col("b.k"), F.lit(0)).cast("int").alias("predicted"), F.coalesce("b.score", F.lit(-1.0)).alias("score"))


def match(events: DataFrame, protos: DataFrame, kind: str = "iou") -> DataFrame:
    """idx, predicted, score of each event."""
    return top_class(class_scores(events, protos, kind))


def channel_scores(features: DataFrame, protos: DataFrame, kind: str = "iou") -> DataFrame:
    """idx, label, expert, channel, score. features: idx, channel, lo, hi; protos with expert and channel.

    An equi-join on the channel; within it every class and expert is tried.
    """
    p = bounded(protos.select("label", "expert", "channel", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "weight"))
    score = similarity(F.col("lo"), F.col("hi"), F.col("p_lo"), F.col("p_hi"), kind) * F.col("weight").cast("double")
    return features.join(p, "channel").groupBy("idx", "label", "expert", "channel").agg(F.max(score).alias("score"))


def expert_scores(scores: DataFrame) -> DataFrame:
    """idx, label, expert, score: four tiles and half the patch channel, over 4.5, in 32-bit steps in channel order.

    A bank without prototypes counts 0.
    """
    by_channel = [F.coalesce(F.max(F.when(F.col("channel") == c, F.col("score").cast("float"))), F.lit(0.0).cast("float")) for c in range(CHANNELS)]
    return scores.groupBy("idx", "label", "expert").agg(weighted(by_channel).alias("score"))


def weighted(channels: list[Column]) -> Column:
    acc = F.lit(0.0).cast("float")
    for c, score in enumerate(channels):
        acc = (acc + (score if c < CHANNELS - 1 else (score * F.lit(PATCH_WEIGHT).cast("float")).cast("float"))).cast("float")
    return (acc / F.lit(CHANNELS - 1 + PATCH_WEIGHT).cast("float")).cast("float")


def top_expert(scores: DataFrame) -> DataFrame:
    """idx, label, expert, score: the best expert of each class, the lowest of equals."""
    best = scores.groupBy("idx", "label").agg(F.max(F.struct("score", (-F.col("expert")).alias("k"))).alias("b"))
    return best.select("idx", "label", (-F.col("b.k")).cast("int").alias("expert"), F.col("b.score").alias("score"))


def top_class_and_expert(scores: DataFrame) -> DataFrame:
    """idx, predicted, expert, score: the best expert of the best class; ties to the lowest class, then expert."""
    best = scores.groupBy("idx").agg(F.max(F.struct("score", (-F.col("label")).alias("l"), (-F.col("expert")).alias("e"))).alias("b"))
    return best.select("idx", (-F.col("b.l")).cast("int").alias("predicted"), (-F.col("b.e")).cast("int").alias("expert"), F.col("b.score").alias("score"))


def match_batches(samples: DataFrame, protos: DataFrame, event_col: str = "event", kind: str = "iou") -> DataFrame:
    """``samples`` with predicted and score, in one pass without a shuffle: the volume path of ``match``."""
    rows = bounded(protos).select("label", "lo", "hi", "weight").orderBy("label").toPandas()
    labels = np.unique(rows["label"].to_numpy())
    memory = samples.sparkSession.sparkContext.broadcast((labels, rows[["lo", "hi"]].to_numpy(np.int64), rows["weight"].to_numpy(np.float64), np.searchsorted(rows["label"].to_numpy(), labels)))

    def run(events: pa.Array) -> pa.Array:
        labels, stored, weight, first = memory.value
        e = np.stack([events.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
        best, score = np.zeros(len(e), dtype=np.int32), np.full(len(e), -1.0)
        if len(labels):
            for at in range(0, len(e), 2048):
                s = similarity_np(e[at : at + 2048, None, :], stored[None], kind) * weight
                by_class = np.maximum.reduceat(s, first, axis=1)
                best[at : at + 2048], score[at : at + 2048] = labels[by_class.argmax(axis=1)], by_class.max(axis=1)
        return pa.StructArray.from_arrays([pa.array(best), pa.array(score)], names=["predicted", "score"])

    kind_of = T.StructType([T.StructField("predicted", T.IntegerType()), T.StructField("score", T.DoubleType())])
    marked = with_batch_column(samples, "_m", kind_of, run, event_col)
    return marked.withColumns({"predicted": F.col("_m.predicted"), "score": F.col("_m.score")}).drop("_m")
