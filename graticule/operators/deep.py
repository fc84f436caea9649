"""A convolutional spiking classifier: rate code, two spiking convolutions, a class readout with softmax.

28x28 pixels become spikes over ``steps`` time steps by a deterministic rate code. 12 filters of 5x5 and 24 of
3x3, both with stride 2 and a bias, fire where their input is positive; gradients pass the threshold straight
through a window around it. The readout is averaged over time. Training is mini-batch Adam on cross-entropy; an
epoch runs on every partition from the same weights, and the weights are averaged by rows after it. With one
partition that is plain sequential training. What reaches the driver is one set of weights per partition.
"""

from __future__ import annotations

import pickle
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import with_batch_column
from ..schemas import Split
from .transform import class_index, public_label

FIRST, SECOND = 12, 24
SIDE1, SIDE2 = 12, 5
MOST_PARTS = 64


def parameter_count(classes: int) -> int:
    return FIRST * 25 + FIRST + SECOND * FIRST * 9 + SECOND + (SECOND * SIDE2 * SIDE2 + 1) * classes


def neuron_count(classes: int) -> int:
    return FIRST * SIDE1 * SIDE1 + SECOND * SIDE2 * SIDE2 + classes


@dataclass(frozen=True)
class TrainingConfig:
    epochs: int = 5
    batch_size: int = 64
    time_steps: int = 8
    learning_rate: float = 0.001
    seed: int = 1
    augment: bool = True


def initial(classes: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    weights = lambda n, *shape: rng.normal(0, np.sqrt(2.0 / n), shape)
    return {
        "w1": weights(25, 25, FIRST), "b1": np.zeros(FIRST), "w2": weights(FIRST * 9, FIRST * 9, SECOND), "b2": np.zeros(SECOND),
        "w3": weights(SECOND * SIDE2**2, SECOND * SIDE2**2, classes), "b3": np.zeros(classes),
    }


def rate_code(pixels: np.ndarray, steps: int) -> np.ndarray:
    """(steps, n, 28, 28): a pixel of share x of full brightness fires x * steps times, evenly spread."""
    x = pixels.reshape(len(pixels), 28, 28) / 255.0
    t = np.arange(steps + 1).reshape(-1, 1, 1, 1)
    return np.diff(np.floor(t * x + 1e-9), axis=0)


def _patches(x: np.ndarray, k: int) -> np.ndarray:
    """(n, h, w, channels) as (n, h', w', k * k * channels) with stride 2."""
    view = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(1, 2))[:, ::2, ::2]
    return view.transpose(0, 1, 2, 4, 5, 3).reshape(*view.shape[:3], -1)


def _fire(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spikes and the surrogate derivative."""
    return (v > 0).astype(np.float64), (np.abs(v) < 1.0).astype(np.float64)


def forward(params: dict, pixels: np.ndarray, steps: int):
    spikes = rate_code(pixels, steps)
    x = spikes.reshape(-1, 28, 28, 1)
    p1 = _patches(x, 5)
    s1, d1 = _fire(p1 @ params["w1"] + params["b1"])
    p2 = _patches(s1, 3)
    s2, d2 = _fire(p2 @ params["w2"] + params["b2"])
    flat = s2.reshape(steps, len(pixels), -1)
    mean = flat.mean(axis=0)
    z = mean @ params["w3"] + params["b3"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), (p1, d1, p2, d2, mean)


def gradients(params: dict, pixels: np.ndarray, y: np.ndarray, steps: int):
    """(gradients, summed loss, number right)."""
    n = len(y)
    p, (p1, d1, p2, d2, mean) = forward(params, pixels, steps)
    loss, right = -np.log(np.maximum(1e-12, p[np.arange(n), y])).sum(), int((p.argmax(axis=1) == y).sum())
    dz = p.copy()
    dz[np.arange(n), y] -= 1
    dz /= n
    g = {"w3": mean.T @ dz, "b3": dz.sum(axis=0)}
    ds2 = np.broadcast_to((dz @ params["w3"].T / steps)[None], (steps, n, mean.shape[1])).reshape(-1, SIDE2, SIDE2, SECOND)
    dv2 = ds2 * d2
    g["w2"], g["b2"] = np.tensordot(p2, dv2, axes=([0, 1, 2], [0, 1, 2])), dv2.sum(axis=(0, 1, 2))
    dp2 = (dv2 @ params["w2"].T).reshape(-1, SIDE2, SIDE2, 3, 3, FIRST)
    ds1 = np.zeros((len(dp2), SIDE1, SIDE1, FIRST))
    for r in range(3):
        for c in range(3):
            ds1[:, r : r + 2 * SIDE2 - 1 : 2, c : c + 2 * SIDE2 - 1 : 2] += dp2[:, :, :, r, c]
    dv1 = ds1 * d1
    g["w1"], g["b1"] = np.tensordot(p1, dv1, axes=([0, 1, 2], [0, 1, 2])), dv1.sum(axis=(0, 1, 2))
    return g, loss, right


def shift_images(pixels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each image moved by up to a pixel along both axes."""
    image = np.pad(pixels.reshape(-1, 28, 28), ((0, 0), (1, 1), (1, 1)))
    r, c = rng.integers(0, 3, (2, len(image)))
    at = np.arange(28)
    return image[np.arange(len(image))[:, None, None], r[:, None, None] + at[None, :, None], c[:, None, None] + at[None, None, :]].reshape(len(image), -1)


def run_epoch(state: dict, pixels: np.ndarray, y: np.ndarray, config: TrainingConfig, epoch: int, part: int) -> tuple[dict, float, int]:
    """One pass of mini-batches over rows held by one partition."""
    rng = np.random.default_rng((config.seed, epoch, part))
    params, m, v, t = {k: a.copy() for k, a in state["params"].items()}, {k: a.copy() for k, a in state["m"].items()}, {k: a.copy() for k, a in state["v"].items()}, state["t"]
    order, loss, right = rng.permutation(len(y)), 0.0, 0
    for at in range(0, len(order), config.batch_size):
        rows = order[at : at + config.batch_size]
        x = shift_images(pixels[rows], rng) if config.augment else pixels[rows]
        g, batch_loss, batch_right = gradients(params, x, y[rows], config.time_steps)
        loss, right, t = loss + batch_loss, right + batch_right, t + 1
        for k in params:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            params[k] -= config.learning_rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return {"params": params, "m": m, "v": v, "t": t}, loss, right


class DeepClassifier:
    """Train, evaluate and predict on samples of 28x28 images."""

    def __init__(self, split: Split, config: TrainingConfig = TrainingConfig(), parts: int = 1):
        if not 1 <= parts <= MOST_PARTS:
            raise ValueError(f"parts must lie between 1 and {MOST_PARTS}")
        self.split, self.config, self.parts = split, config, parts
        params = initial(split.classes, config.seed)
        zero = lambda: {k: np.zeros_like(a) for k, a in params.items()}
        self.state = {"params": params, "m": zero(), "v": zero(), "t": 0}

    @property
    def parameters(self) -> int:
        return sum(a.size for a in self.state["params"].values())

    @property
    def neurons(self) -> int:
        return neuron_count(self.split.classes)

    def train(self, samples: DataFrame) -> list[dict]:
        """A row of EPOCHS for each epoch. A partition's rows, as bytes, are held by its worker: choose ``parts`` by their size."""
        sc, config = samples.sparkSession.sparkContext, self.config
        rows = samples.select("idx", class_index(F.col("label"), self.split).alias("y"), "pixels").repartitionByRange(self.parts, "idx").sortWithinPartitions("idx")
        out = []
        for epoch in range(config.epochs):
            began, shared = time.perf_counter(), sc.broadcast(self.state)

            def run(batches, epoch=epoch, shared=shared):
                from pyspark import TaskContext

                pixels, y = [], []
                for batch in batches:
                    pixels.append(batch.column("pixels").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(batch.num_rows, -1))
                    y.append(batch.column("y").to_numpy())
                if pixels:
                    x, labels = np.concatenate(pixels), np.concatenate(y)
                    state, loss, right = run_epoch(shared.value, x, labels, config, epoch, TaskContext.get().partitionId())
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary()), pa.array([len(labels)], pa.int64()), pa.array([loss]), pa.array([right], pa.int64())], names=["state", "n", "loss", "right"])

            found = rows.mapInArrow(run, "state binary, n bigint, loss double, right bigint").collect()
            n = sum(r.n for r in found)
            if n:
                states = [(pickle.loads(r.state), r.n / n) for r in found]
                mean = lambda name: {k: sum(s[name][k] * w for s, w in states) for k in self.state[name]}
                self.state = {"params": mean("params"), "m": mean("m"), "v": mean("v"), "t": max(s["t"] for s, _ in states)}
            out.append({"epoch": epoch + 1, "loss": sum(r.loss for r in found) / max(1, n), "accuracy": sum(r.right for r in found) / max(1, n), "seconds": time.perf_counter() - began})
        return out

    def predict(self, samples: DataFrame) -> DataFrame:
        """idx, actual, predicted, loss."""
        shared, steps, split = samples.sparkSession.sparkContext.broadcast(self.state["params"]), self.config.time_steps, self.split

        def run(pixels: pa.Array, labels: pa.Array) -> pa.Array:
            x = pixels.flatten().to_numpy(zero_copy_only=False).reshape(len(pixels), -1)
            y = labels.to_numpy(zero_copy_only=False) - split.offset
            best, loss = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            for at in range(0, len(x), 256):
                p, _ = forward(shared.value, x[at : at + 256], steps)
                best[at : at + 256] = p.argmax(axis=1)
                loss[at : at + 256] = -np.log(np.maximum(1e-12, p[np.arange(len(p)), y[at : at + 256]]))
            return pa.StructArray.from_arrays([pa.array(best), pa.array(loss)], names=["best", "loss"])

        kind = T.StructType([T.StructField("best", T.IntegerType()), T.StructField("loss", T.DoubleType())])
        marked = with_batch_column(samples, "_m", kind, run, "pixels", "label")
        return marked.select("idx", F.col("label").alias("actual"), public_label(F.col("_m.best"), split).alias("predicted"), F.col("_m.loss").alias("loss"))

    def evaluate(self, samples: DataFrame) -> dict:
        r = self.predict(samples).agg(F.sum((F.col("predicted") == F.col("actual")).cast("int")).alias("c"), F.count("*").alias("n"), F.avg("loss").alias("l")).first()
        return {"correct": r.c or 0, "total": r.n, "accuracy": (r.c or 0) / r.n if r.n else 0.0, "loss": r.l or 0.0}
