"""Confusion, accuracy, gates and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Split


def confusion(preds: DataFrame) -> DataFrame:
    """actual, predicted, n of the pairs that occur."""
    return preds.groupBy(F.col("actual").cast("int").alias("actual"), F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def full_confusion(preds: DataFrame, classes: int = 10) -> DataFrame:
    """actual, predicted, n of every pair of classes, zeros too."""
    spark = preds.sparkSession
    one = spark.range(classes * classes).select((F.expr(f"id div {classes}")).cast("int").alias("actual"), (F.col("id") % classes).cast("int").alias("predicted"))
    return one.join(confusion(preds), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def evaluation(preds: DataFrame, *by: str) -> DataFrame:
    """by..., correct, total, accuracy; the accuracy of no rows is 0."""
    grouped = preds.groupBy(*by) if by else preds
    found = grouped.agg(F.coalesce(F.sum((F.col("predicted") == F.col("actual")).cast("bigint")), F.lit(0)).cast("bigint").alias("correct"), F.count("*").alias("total"))
    return found.withColumn("accuracy", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("correct").cast("double") / F.greatest(F.lit(1), F.col("total"))))


def floor_of(value: float) -> float:
    """A gate's floor as it acts: rounded to 32 bits, then widened, so 8500 of 10000 fail 0.85."""
    return float(np.float32(value))


def passes(accuracy: Column, floor: float) -> Column:
    return ~(accuracy < F.lit(floor_of(floor)))


def confusion_text(counts: DataFrame, classes: int = 10) -> str:
    """The report's grid; ``counts`` is bounded by classes * classes rows."""
    cells = {(r.actual, r.predicted): r.n for r in counts.collect()}
    lines = ["", "confusion matrix (rows=actual, columns=predicted)", "    " + "".join(f"{c:>6}" for c in range(classes))]
    lines += [f"{a:>3} " + "".join(f"{cells.get((a, p), 0):>6}" for p in range(classes)) for a in range(classes)]
    return "\n".join(lines) + "\n"


#: Fixed value: the columns of the battery's report.
CSV_HEADER = "split,classes,train_samples,test_samples,train_seconds,test_seconds,correct,accuracy_percent"


def csv_line(split: Split, train: int, test: int, train_seconds: float, test_seconds: float, correct: int, accuracy: float) -> str:
    return f"{split.name},{split.classes},{train},{test},{train_seconds:.3f},{test_seconds:.3f},{correct},{accuracy * 100:.2f}"


def write_report(runs: DataFrame, path: str) -> None:
    """The battery's report as CSV files with a header, times to three decimals and percent to two."""
    fixed = lambda c, d: F.regexp_replace(F.format_number(c, d), ",", "").alias(c)
    runs.select("split", "classes", "train_samples", "test_samples", fixed("train_seconds", 3), fixed("test_seconds", 3), "correct", fixed("accuracy_percent", 2)).write.mode("overwrite").option("header", True).csv(path)


def epoch_line(epoch: int, loss: float, accuracy: float, seconds: float) -> str:
    return f"epoch={epoch} loss={loss:.5f} train_accuracy={accuracy * 100:.2f}% seconds={seconds:.3f}"


def deep_report(split: Split, train: int, test: int, steps: int, parameters: int, neurons: int, epochs: list[dict], result: dict, train_seconds: float, test_seconds: float) -> str:
    lines = [f"split={split.name} classes={split.classes} train_samples={train} test_samples={test} timesteps={steps} parameters={parameters} neurons={neurons}"]
    lines += [epoch_line(**e) for e in epochs]
    lines += [f"test_correct={result['correct']}/{result['total']} test_accuracy={result['accuracy'] * 100:.2f}% test_loss={result['loss']:.5f}", f"train_seconds={train_seconds:.3f} test_seconds={test_seconds:.3f}"]
    return "\n".join(lines) + "\n"
