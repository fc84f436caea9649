"""Quality from compression with dictionaries of good and of bad text (operator 4).

Two zstandard dictionaries are trained on all pieces of labelled good and bad texts. A text is split into pieces; each is
compressed with either dictionary, and the difference of the sizes over their sum tells which it resembles.
The mean of these normalised differences becomes a probability by a logistic curve fitted on labelled texts that the
dictionaries have not seen; how far the text packs without a dictionary sets the curve's level, as a difference
says less of a text that packs poorly.

Defined results: null and empty texts get the score of an empty text (nothing resembles either side); texts of any
length are read whole, piece by piece; without labelled rows of both classes every score is the default 0.5; repeated
rows, and texts that tie, get equal scores; an empty table gives an empty result; other columns pass through unread,
but one named as ``into`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import labelled_sample
from .workspace import small_batches

PIECE = 2048
LEVEL = 3


@dataclass
class CompressionClassifier:
    """Fitted dictionaries and calibration; usable on executors."""

    good: bytes = b""
    bad: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], dict_bytes: int = 112_640) -> CompressionClassifier:
        """Two thirds of each class fill the dictionaries, the others the calibration."""
        parts: dict[tuple[int, bool], list[str]] = {(y, z): [] for y in (0, 1) for z in (False, True)}
        for i, (text, y) in enumerate(sample):
            parts[y, i % 3 == 0].append(text)
        if not all(parts.values()):
            return cls()
        model = cls(_content(parts[1, False], dict_bytes), _content(parts[0, False], dict_bytes))
        texts = parts[1, True] + parts[0, True]
        y = np.array([1.0] * len(parts[1, True]) + [0.0] * len(parts[0, True]))
        model.weights = _logistic(_expand(model.features(pa.array(texts))), y)
        return model

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: mean normalised difference, and packed share without a dictionary."""
        plain, good, bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False) for d in (None, *map(_loaded, (self.good, self.bad))))
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            data = memoryview(text.as_buffer()) if text.is_valid else b""
            n = len(data)
            if not n:
                continue
            diff, packed, count = 0.0, 0, max(1, n // PIECE)
            for k in range(count):
                piece = data[k * PIECE : (k + 1) * PIECE if k + 1 < count else n]
                a, b = len(good.compress(piece)), len(bad.compress(piece))
                diff += (b - a) / (a + b)
                packed += len(plain.compress(piece))
            out[i] = diff / count, packed / n
        return out

    def score(self, texts: pa.Array) -> pa.Array:
        if len(self.weights) == 1:
            return pa.array(np.full(len(texts), 0.5))
        z = _expand(self.features(texts)) @ self.weights
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _loaded(content: bytes) -> zstandard.ZstdCompressionDict | None:
    """Trained dictionaries begin with bytes that no text does; other content is taken as it is."""
    if not content:
        return None
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    made.precompute_compress(level=LEVEL)
    return made


def _content(texts: list[str], size: int) -> bytes:
    """All texts where they fit, else a dictionary trained on all pieces of all texts."""
    data = [text.encode() for text in texts]
    if sum(map(len, data)) <= size:
        return b"".join(data)
    pieces = [d[k : k + PIECE] for d in data for k in range(0, len(d), PIECE)]
    return zstandard.train_dictionary(size, pieces, k=256, d=8, level=LEVEL).as_bytes()


def _expand(x: np.ndarray) -> np.ndarray:
    """Terms of the calibration: both features, bounded, their squares and product."""
    d, p = np.tanh(x[:, 0] * 12), x[:, 1] * 2
    return np.column_stack([np.ones(len(x)), d, p, d * d, d * p, p * p])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method; every text of the sample weighs alike."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> CompressionClassifier:
    """Fit on at most ``per_class`` labelled texts of each class, outside the held-out fold."""
    return CompressionClassifier.fit(labelled_sample(docs, labels, "quality", per_class))


def with_quality(docs: DataFrame, model: CompressionClassifier, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1, higher for label 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, F.arrow_udf(lambda t, shared=shared: shared.value.score(t), T.DoubleType())(F.col(text_col)))
