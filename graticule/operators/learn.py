"""Prototype learners.

The update rule of the original memories is not public. Ours, stated once here: a memory holds up to
``capacity`` prototypes with weights in [0, 1] and scores an event by its best weighted similarity. ``reinforce``
with reward r: below the novelty threshold a positive reward appends the event with the initial weight (the
oldest goes when full); otherwise the best prototype's weight moves by learning rate times r. A negative reward
never appends. ``remember`` appends while there is room. There is no replay.

Classes of the baseline learners share no state, so their rows are folded by class in parallel. The structured
learner lets classes correct each other, so its rows are one ordered fold: features are computed by Spark, and
only their 80 bytes a row pass the driver, partition by partition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import geometry as G
from ..functions.similarity import similarity_np
from ..schemas import PROTOTYPES, Split
from .encode import encode_features_batch, encode_images_batch
from .evaluate import evaluation
from .match import CHANNELS, channel_scores, expert_scores, match_batches, top_class_and_expert
from .transform import augmentation, check_labels, class_index, public_label

EXPERTS, BANK = 4, 64
HARD_EVERY, HARD_REWARD = 16, -0.5


def check_parameters(novelty: float, rate: float, finite: bool = True) -> None:
    if not 0.0 <= novelty <= 1.0:
        raise ValueError("novelty threshold must be in the range 0-1")
    if not rate > 0.0 or finite and not np.isfinite(rate):
        raise ValueError("reward learning rate must be finite and positive")


@dataclass
class Memory:
    """A bounded list of weighted prototypes."""

    capacity: int = 256
    novelty: float = 0.78
    rate: float = 0.35
    kind: str = "iou"
    events: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, event: np.ndarray) -> np.ndarray:
        return similarity_np(self.events, event, self.kind) * self.weights

    def evaluate(self, event: np.ndarray) -> float:
        return float(self.scores(event).max()) if len(self.events) else 0.0

    def remember(self, event: np.ndarray, weight: float = 1.0) -> None:
        if len(self.events) < self.capacity:
            self._append(event, weight)

    def _append(self, event: np.ndarray, weight: float) -> None:
        keep = slice(max(0, len(self.events) + 1 - self.capacity), None)
        self.events = np.concatenate([self.events[keep], event[None]])
        self.weights = np.concatenate([self.weights[keep], [weight]])

    def reinforce(self, event: np.ndarray, reward: float, initial: float = 1.0) -> None:
        like = similarity_np(self.events, event, self.kind) if len(self.events) else np.zeros(0)
        if not len(like) or like.max() < self.novelty:
            if reward > 0:
                self._append(event, initial)
            return
        best = int(like.argmax())
        self.weights[best] = min(1.0, max(0.0, self.weights[best] + self.rate * reward))


def train_baseline(samples: DataFrame, rows: int, columns: int, split: Split, multiplier: float = 1.30, novelty: float = 0.78, rate: float = 0.35, epochs: int = 1, capacity: int = 256, kind: str = "iou") -> DataFrame:
    """PROTOTYPES (label: class index) learnt online, in file order, by the labelled class alone."""
    check_parameters(novelty, rate, finite=split.offset == 0)
    encoded = encode_images_batch(samples, rows, columns, multiplier).select("idx", class_index(F.col("label"), split).alias("label"), "event.lo", "event.hi")

    def fold(key, pdf):
        memory = Memory(capacity, novelty, rate, kind)
        events = pdf.sort_values("idx", kind="stable")[["lo", "hi"]].to_numpy(np.int64)
        for _ in range(epochs):
            for event in events:
                memory.reinforce(event, 1.0)
        n = len(memory.events)
        zeros = np.zeros(n, dtype=np.int32)
        return pd.DataFrame({"label": zeros + key[0], "expert": zeros, "channel": zeros, "slot": np.arange(n, dtype=np.int32), "lo": memory.events[:, 0], "hi": memory.events[:, 1], "weight": memory.weights.astype(np.float32)})

    return encoded.groupBy("label").applyInPandas(fold, PROTOTYPES)


def remember_first(events: DataFrame, capacity: int = 256) -> DataFrame:
    """PROTOTYPES of each label's first ``capacity`` events in file order: memories that only remember, without a fold.

    events: idx, label, lo, hi. Spark keeps at most ``capacity`` rows of a label in each partition before the shuffle.
    """
    order = W.Window.partitionBy("label").orderBy("idx")
    kept = events.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= capacity)
    zero = F.lit(0)
    return kept.select(F.col("label").cast("int").alias("label"), zero.alias("expert"), zero.alias("channel"), (F.col("_k") - 1).cast("int").alias("slot"), "lo", "hi", F.lit(1.0).cast("float").alias("weight"))


def predict_baseline(samples: DataFrame, protos: DataFrame, rows: int, columns: int, split: Split, multiplier: float = 1.30, kind: str = "iou") -> DataFrame:
    """idx, actual, predicted, score with public labels."""
    found = match_batches(encode_images_batch(samples, rows, columns, multiplier), protos, kind=kind)
    return found.select("idx", F.col("label").alias("actual"), public_label(F.col("predicted"), split).alias("predicted"), "score")


class StructuredLearner:
    """Experts per class, each with one bank per channel, and the fold that trains them."""

    def __init__(self, split: Split, novelty: float = 0.78, rate: float = 0.35, kind: str = "iou"):
        check_parameters(novelty, rate)
        self.split = split
        self.banks = [[[Memory(BANK, novelty, rate, kind) for _ in range(CHANNELS)] for _ in range(EXPERTS)] for _ in range(split.classes)]
        self.assigned = np.zeros((split.classes, EXPERTS), dtype=np.int64)

    def expert_score(self, label: int, expert: int, features: np.ndarray) -> np.float32:
        banks, acc = self.banks[label][expert], np.float32(0)
        for c in range(CHANNELS):
            acc = np.float32(acc + np.float32(1.0 if c < CHANNELS - 1 else 0.5) * np.float32(banks[c].evaluate(features[c])))
        return np.float32(acc / np.float32(CHANNELS - 0.5))

    def choose(self, label: int, features: np.ndarray) -> int:
        """The first expert without assignments; else the best of those with room; else the best of all."""
        idle = np.flatnonzero(self.assigned[label] == 0)
        if len(idle):
            return int(idle[0])
        room = [e for e in range(EXPERTS) if len(self.banks[label][e][0].events) < BANK] or list(range(EXPERTS))
        return max(room, key=lambda e: (self.expert_score(label, e, features), -e))

    def predict(self, features: np.ndarray) -> tuple[int, int]:
        return max(((label, e) for label in range(self.split.classes) for e in range(EXPERTS)), key=lambda p: (self.expert_score(*p, features), -p[0], -p[1]))

    def learn(self, idx: int, label: int, features: np.ndarray) -> None:
        expert = self.choose(label, features)
        for c in range(CHANNELS):
            self.banks[label][expert][c].remember(features[c])
        self.assigned[label, expert] += 1
        if idx % HARD_EVERY == 0:
            predicted, rival = self.predict(features)
            if predicted != label:
                for c in range(CHANNELS):
                    self.banks[predicted][rival][c].reinforce(features[c], HARD_REWARD)

    def train(self, samples: DataFrame, epochs: int = 1, ink: int = G.INK) -> StructuredLearner:
        for epoch in range(epochs):
            dx, dy = augmentation(F.col("idx"), epoch)
            rows = encode_features_batch(samples, dx, dy, ink).select("idx", class_index(F.col("label"), self.split).alias("label"), "features").orderBy("idx")
            for row in rows.toLocalIterator(prefetchPartitions=True):
                self.learn(row.idx, row.label, np.array([(e.lo, e.hi) for e in row.features], dtype=np.int64))
        return self

    def prototypes(self, spark) -> DataFrame:
        """PROTOTYPES with class indexes."""
        out = [
            (label, e, c, slot, int(lo), int(hi), float(w))
            for label, experts in enumerate(self.banks) for e, banks in enumerate(experts) for c, m in enumerate(banks)
            for slot, ((lo, hi), w) in enumerate(zip(m.events, m.weights))
        ]
        return spark.createDataFrame(out, PROTOTYPES)


def predict_structured(samples: DataFrame, protos: DataFrame, split: Split, ink: int = G.INK, kind: str = "iou") -> DataFrame:
    """idx, actual, predicted, expert, score with public labels; no extra shift."""
    encoded = encode_features_batch(samples, ink=ink, kind=kind)
    features = encoded.select("idx", F.posexplode("features").alias("channel", "e")).select("idx", "channel", "e.lo", "e.hi")
    best = top_class_and_expert(expert_scores(channel_scores(features, protos, kind)))
    return samples.select("idx", F.col("label").alias("actual")).join(best, "idx").select("idx", "actual", public_label(F.col("predicted"), split).alias("predicted"), "expert", "score")


def evaluate_baseline(samples: DataFrame, protos: DataFrame, rows: int, columns: int, split: Split, multiplier: float = 1.30) -> DataFrame:
    return evaluation(predict_baseline(check_labels(samples, split), protos, rows, columns, split, multiplier))
