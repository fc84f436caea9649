"""The engine's registered queries over ``embeddings`` (8x8 images, labels 0-9; rows with idx % 5 = 0 test) and ``labels``.

The table stands in for image files: results are exact, accuracies mean nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import encode, evaluate, learn, match, transform
from ..operators.deep import DeepClassifier, TrainingConfig
from ..schemas import Split, split_table
from ..session import shared_dir
from ..sources import idx as idx_source
from ..sources import vectors
from .sql import ORACLES

MULTIPLIER = 1.3
INK = 100
TEN = Split("digits", 10)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_samples(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores, as one small file gives, dealt over all of them; others as they are.

    Encoding costs far more than moving 64 floats a row.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.enlarge(samples(spark, sf_dir), 8, 8)


def events(spark: SparkSession, sf_dir: str, multiplier: float = MULTIPLIER) -> DataFrame:
    return encode.encode_images(samples(spark, sf_dir), 8, 8, multiplier).select("idx", "label", "event.lo", "event.hi")


def _train(df: DataFrame) -> DataFrame:
    return df.where("idx % 5 <> 0")


def _test(df: DataFrame) -> DataFrame:
    return df.where("idx % 5 = 0")


def micro(score: str | Column) -> Column:
    return F.round((F.col(score) if isinstance(score, str) else score).cast("double") * 1_000_000).cast("bigint").alias("score_e6")


def predictions(spark: SparkSession, sf_dir: str, multiplier: float = MULTIPLIER, capacity: int = 256) -> DataFrame:
    """idx, actual, predicted, score of the test rows."""
    found = events(spark, sf_dir, multiplier)
    best = match.match(_test(found), learn.remember_first(_train(found), capacity))
    return _test(samples(spark, sf_dir)).select("idx", F.col("label").alias("actual")).join(best, "idx")


def class_scores(spark, sf_dir):
    found = events(spark, sf_dir)
    return match.class_scores(_test(found), learn.remember_first(_train(found))).select("idx", "label", micro("score"))


def top_class(spark, sf_dir):
    return predictions(spark, sf_dir).select("idx", "actual", "predicted", micro("score"))


def confusion(spark, sf_dir):
    return evaluate.confusion(predictions(spark, sf_dir))


def full_confusion(spark, sf_dir):
    return evaluate.full_confusion(predictions(spark, sf_dir))


def evaluation(spark, sf_dir):
    return evaluate.evaluation(predictions(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


def evaluation_by_class(spark, sf_dir):
    return evaluate.evaluation(predictions(spark, sf_dir), "actual").drop("accuracy")


def accuracy_gate(spark, sf_dir):
    one = evaluate.evaluation(predictions(spark, sf_dir))
    tests = F.array(*[F.struct(F.lit(t).alias("floor_text"), evaluate.passes(F.col("accuracy"), float(t)).alias("passed")) for t in ("0.05", "0.85")])
    return one.select(F.inline(tests))


def encode_images(spark, sf_dir):
    return events(spark, sf_dir).select("idx", "lo", "hi")


def encode_images_batch(spark, sf_dir):
    return encode.encode_images_batch(samples(spark, sf_dir), 8, 8, MULTIPLIER).select("idx", "event.lo", "event.hi")


def prototypes(spark, sf_dir):
    return learn.remember_first(_train(events(spark, sf_dir))).select("label", "slot", "lo", "hi")


def image_mean(spark, sf_dir):
    mean = encode.image_mean(F.col("pixels"))
    return samples(spark, sf_dir).select("idx", encode.total(F.col("pixels")).alias("total"), F.size("pixels").alias("pixels"), F.floor(mean * 1000).cast("bigint").alias("mean_e3"))


def cell_sums(spark, sf_dir):
    """The pooled cells by the exploded route: pixels grouped by cell."""
    cell = F.least(F.lit(9), F.expr("r * 10 div 8")) * 9 + F.least(F.lit(8), F.expr("c * 9 div 8"))
    return transform.explode_pixels(samples(spark, sf_dir)).groupBy("idx", cell.cast("int").alias("cell")).agg(F.sum("pixel").alias("total"), F.count("*").alias("n"))


def ink_box(spark, sf_dir):
    return transform.centering_shift(samples(spark, sf_dir), INK).select("idx", "top", "bottom", "left", "right", "down", "across")


def centered_pixels(spark, sf_dir):
    return transform.explode_pixels(transform.center(samples(spark, sf_dir), INK)).where("pixel <> 0").select("idx", "r", "c", F.col("pixel").alias("v"))


def augmented(spark, sf_dir):
    """The whole shift of every row in two epochs."""
    per = samples(spark, sf_dir).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    dx, dy = transform.augmentation(F.col("idx"), F.col("epoch"))
    return transform.centering_shift(per, INK, dx, dy).select("idx", "epoch", "down", "across")


def detector_bank(spark, sf_dir):
    rows = [(d, slot, *G.words_of(bits)) for d, slot, bits in G.detector_bank()]
    return spark.createDataFrame(rows, "detector int, slot int, lo bigint, hi bigint")


def tiles(spark, sf_dir):
    found = encode.encode_tiles(transform.center(large(spark, sf_dir), INK))
    return found.select("idx", F.posexplode("tiles").alias("channel", "e")).select("idx", "channel", "e.lo", "e.hi")


def patches(spark, sf_dir):
    found = encode.patch_events(transform.center(large(spark, sf_dir), INK))
    return found.select("idx", F.posexplode("patches").alias("patch", "e")).select("idx", "patch", "e.lo", "e.hi")


def _features(spark, sf_dir) -> DataFrame:
    found = encode.encode_features(large(spark, sf_dir), INK)
    return found.select("idx", "label", F.posexplode("features").alias("channel", "e")).select("idx", "label", "channel", "e.lo", "e.hi")


def features(spark, sf_dir):
    return _features(spark, sf_dir).drop("label")


def _features_fast(spark, sf_dir) -> DataFrame:
    found = encode.encode_features_batch(large(spark, sf_dir), ink=INK)
    return found.select("idx", "label", F.posexplode("features").alias("channel", "e")).select("idx", "label", "channel", "e.lo", "e.hi")


def features_batch(spark, sf_dir):
    return _features_fast(spark, sf_dir).drop("label")


def _channel_scores(spark, sf_dir) -> DataFrame:
    """Test rows against full banks: the first 4 x 64 training rows of a class, dealt over four experts in turn."""
    found = _features_fast(spark, sf_dir)
    order = learn.W.Window.partitionBy("label", "channel").orderBy("idx")
    kept = _train(found).withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < learn.EXPERTS * learn.BANK)
    stored = kept.select(F.col("label"), F.expr("cast(k % 4 as int)").alias("expert"), "channel", "lo", "hi", F.lit(1.0).cast("float").alias("weight"))
    return match.channel_scores(_test(found).drop("label"), stored)


def channel_scores(spark, sf_dir):
    return _channel_scores(spark, sf_dir).select("idx", "label", "expert", "channel", micro(F.col("score").cast("float")))


def expert_scores(spark, sf_dir):
    return match.expert_scores(_channel_scores(spark, sf_dir)).select("idx", "label", "expert", micro("score"))


def top_expert(spark, sf_dir):
    return match.top_expert(match.expert_scores(_channel_scores(spark, sf_dir))).select("idx", "label", "expert", micro("score"))


def top_class_and_expert(spark, sf_dir):
    return match.top_class_and_expert(match.expert_scores(_channel_scores(spark, sf_dir))).select("idx", "predicted", "expert", micro("score"))


def splits(spark, sf_dir):
    return split_table(spark)


def label_index(spark, sf_dir):
    at = transform.class_index(F.col("label"), TEN)
    return samples(spark, sf_dir).select("idx", at.alias("class_index"), transform.public_label(at, Split("moved", 10, 1)).alias("public_label"))


def first_rows(spark, sf_dir):
    return transform.first_rows(samples(spark, sf_dir), 100).select("idx", "label")


def hard_negative_rows(spark, sf_dir):
    return transform.every_nth(samples(spark, sf_dir)).select("idx", "label")


def label_confusion(spark, sf_dir):
    preds = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))
    return evaluate.full_confusion(preds, 2)


def sweep(spark, sf_dir):
    """A grid of threshold multipliers and memory sizes, each a run of its own."""
    out = None
    for m in ("1.0", "1.3"):
        for capacity in (8, 256):
            run = evaluate.evaluation(predictions(spark, sf_dir, float(m), capacity)).select(F.lit(m).alias("multiplier"), F.lit(capacity).alias("capacity"), "correct", "total")
            out = run if out is None else out.unionAll(run)
    return out


def idx_scan(spark, sf_dir):
    """All images written as an IDX pair in the shared folder, read back by the source, and summed up."""
    every = samples(spark, sf_dir).select("idx", "pixels", "label")
    stem = f"{shared_dir(spark)}/idx-{uuid.uuid4().hex}"
    records = ((r.pixels, r.label) for r in every.orderBy("idx").toLocalIterator())
    idx_source.write_idx(f"{stem}-images", f"{stem}-labels", records, every.count(), 8, 8)
    found = idx_source.load_idx(spark, f"{stem}-images", f"{stem}-labels")
    moment = F.aggregate(F.transform("pixels", lambda p, i: (p * i).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select("idx", "label", encode.total(F.col("pixels")).alias("total"), moment.alias("moment"))


def rate_encode(spark, sf_dir):
    """Spikes of each image in each of eight time steps: a pixel of share x of full brightness fires x * 8 times, evenly spread."""
    step = F.explode(F.sequence(F.lit(1), F.lit(8)))
    per = samples(spark, sf_dir).select("idx", "pixels", step.alias("step"))
    spikes = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, p: a + F.floor(p * F.col("step") / 255) - F.floor(p * (F.col("step") - 1) / 255))
    return per.select("idx", "step", spikes.alias("spikes"))


def online_baseline(spark, sf_dir):
    """The online baseline learner: PROTOTYPES after one epoch of the training rows."""
    return learn.train_baseline(_train(samples(spark, sf_dir)), 8, 8, TEN, MULTIPLIER)


def _online_predictions(spark, sf_dir) -> DataFrame:
    every = samples(spark, sf_dir)
    protos = learn.train_baseline(_train(every), 8, 8, TEN, MULTIPLIER)
    return learn.predict_baseline(_test(every), protos, 8, 8, TEN, MULTIPLIER)


def online_confusion(spark, sf_dir):
    """Confusion of the test rows by the trained memories."""
    return evaluate.confusion(_online_predictions(spark, sf_dir))


def online_evaluation(spark, sf_dir):
    return evaluate.evaluation(_online_predictions(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


def online_structured(spark, sf_dir):
    """The structured learner on training rows, then idx, actual, predicted, expert of the test rows."""
    every = large(spark, sf_dir)
    learner = learn.StructuredLearner(TEN).train(_train(every), ink=INK)
    return learn.predict_structured(_test(every), learner.prototypes(spark), TEN, INK).drop("score")


def deep_epochs(spark, sf_dir):
    """Two epochs of the convolutional spiking classifier: epoch, loss and accuracy."""
    model = DeepClassifier(TEN, TrainingConfig(epochs=2, batch_size=32, time_steps=4, seed=7, augment=False))
    rows = model.train(_train(large(spark, sf_dir)))
    return spark.createDataFrame([(r["epoch"], float(np.round(r["loss"], 6)), float(r["accuracy"])) for r in rows], "epoch int, loss double, accuracy double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        confusion, top_class, class_scores, evaluation, evaluation_by_class, full_confusion, accuracy_gate, encode_images, encode_images_batch, prototypes, image_mean, cell_sums,
        ink_box, centered_pixels, augmented, detector_bank, tiles, patches, features, features_batch, channel_scores, expert_scores, top_expert, top_class_and_expert,
        splits, label_index, first_rows, hard_negative_rows, label_confusion, sweep, idx_scan, rate_encode, online_baseline, online_confusion, online_evaluation, online_structured, deep_epochs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
