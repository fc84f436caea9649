"""Language identification by averaged hashed subword embeddings (operator 5).

Every run of two, three or four bytes of a text (A-Z lower-cased) has an embedding by its hash; a text is
the mean of them, and a linear softmax over it gives the languages. Embeddings and softmax are trained
together by stochastic gradient descent. A temperature fitted on sampled texts kept from training makes the
highest probability a calibrated score, and a threshold taken there marks predictions to reject.

Defined results: a null text, or one without a letter of any script, is ``und`` with score 0 and rejected;
without training rows every text is; a text with letters always gets a learned language, and rejection is a
separate flag; texts of any length are read whole; of languages that tie the first by name is taken; repeated rows get
equal results; an empty table gives an empty result; other columns pass through unread, but one named as ``into`` is
replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .sampling import fitting_texts, held_out
from .textops import BYTE_KEYS, LOWER, PLACES, U64, mix, slices
from .workspace import small_batches

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
UNKNOWN = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
_LETTER = re.compile(r"[^\W\d_]")


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Per size: the bucket of the run that starts at each byte, BUCKETS where it would leave its row."""
    keys = BYTE_KEYS[LOWER[data]]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    with np.errstate(over="ignore"):
        acc = keys * PLACES[1]
        for size in range(2, max(SIZES) + 1):
            acc[: len(acc) - size + 1] += keys[size - 1 :] * PLACES[size]
            if size in SIZES:
                bucket = ((acc * PLACES[20 + size]) >> U64(48)).astype(np.int64) & (BUCKETS - 1)
                bucket[left < size] = BUCKETS
                yield bucket


@dataclass
class LanguageModel:
    """logits: of each bucket (the embedding times the softmax weights), with a row of zeros at the end."""

    langs: list[str] = field(default_factory=list)
    logits: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    floor: float = 0.0

    @classmethod
    def fit(cls, sample: list[tuple[str, str]], dim: int = 16, epochs: int = 12, rate: float = 4.0, batch: int = 32, keep: float = 0.995, seed: int = 11) -> LanguageModel:
        """Four fifths of the sample train; the others set the temperature and the rejection threshold."""
        langs = sorted({lang for _, lang in sample})
        if not langs:
            return cls()
        y = np.array([langs.index(lang) for _, lang in sample])
        first, bucket, weight = _sparse(pa.array([t for t, _ in sample]))
        rng = np.random.default_rng(seed)
        check = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), dtype=bool)
        embed = rng.normal(0, 0.3, (BUCKETS, dim)).astype(np.float32)
        soft = rng.normal(0, 0.3, (dim, len(langs))).astype(np.float32)
        bias = np.zeros(len(langs))
        train = np.flatnonzero(~check)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            order = rng.permutation(train)
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                spans = [slice(first[r], first[r + 1]) for r in rows]
                mean = np.stack([weight[s] @ embed[bucket[s]] if s.stop > s.start else np.zeros(dim, dtype=np.float32) for s in spans])
                p = _softmax(mean @ soft + bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ soft.T).astype(np.float32)
                soft -= (0.3 * step * mean.T @ p).astype(np.float32)
                bias -= 0.1 * step * p.sum(axis=0)
                for s, g in zip(spans, back):
                    embed[bucket[s]] -= step * len(rows) * 4 * weight[s][:, None] * g
        model = cls(langs, np.vstack([embed @ soft, np.zeros((1, len(langs)))]).astype(np.float32), bias)
        model._calibrate(first, bucket, weight, y, np.flatnonzero(check), keep)
        return model

    def _calibrate(self, first, bucket, weight, y, rows, keep):
        if not len(rows):
            return
        z = np.stack([weight[first[r] : first[r + 1]] @ self.logits[bucket[first[r] : first[r + 1]]] for r in rows]) + self.bias
        grid = np.geomspace(0.05, 20, 60)
        losses = [-np.log(np.maximum(1e-12, _softmax(z / t)[np.arange(len(rows)), y[rows]])).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])
        p = _softmax(z / self.temperature)
        right = p.argmax(axis=1) == y[rows]
        if right.any():
            self.floor = float(np.quantile(p.max(axis=1)[right], 1 - keep))

    def predict(self, texts: pa.Array) -> pa.StructArray:
        n = len(texts)
        names, scores = [UNKNOWN] * n, np.zeros(n)
        columns = [np.ascontiguousarray(c) for c in self.logits.T]
        for base, data, offsets in slices(texts):
            rows = len(offsets) - 1
            low = LOWER[data]
            letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
            known = np.diff(letters[offsets]) > 0
            for r in np.flatnonzero(~known & (np.diff(offsets) > 0)):
                known[r] = bool(_LETTER.search(bytes(data[offsets[r] : offsets[r + 1]]).decode("utf-8", "replace")))
            if not self.langs or not known.any():
                continue
            some = np.flatnonzero(np.diff(offsets) > 0)
            z, count = np.zeros((rows, len(self.langs))), np.zeros(rows)
            for size, bucket in zip(SIZES, _grams(data, offsets)):
                for k, column in enumerate(columns):
                    z[some, k] += np.add.reduceat(column[bucket], offsets[some])
                count += np.maximum(0, np.diff(offsets) - size + 1)
            p = _softmax((z / np.maximum(1, count)[:, None] + self.bias) / self.temperature)
            best = p.argmax(axis=1)
            for r in np.flatnonzero(known):
                names[base + r], scores[base + r] = self.langs[best[r]], p[r, best[r]]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array([a == UNKNOWN or s < self.floor for a, s in zip(names, scores)], pa.bool_())], names=RESULT.names)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sparse(texts: pa.Array):
    """Rows of distinct buckets with their shares of the row's runs."""
    sizes, buckets, weights = [0], [], []
    for _, data, offsets in slices(texts):
        grams = list(_grams(data, offsets))
        for a, b in zip(offsets[:-1], offsets[1:]):
            own, count = np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True)
            count = count[own < BUCKETS]
            own = own[own < BUCKETS]
            sizes.append(len(own))
            buckets.append(own)
            weights.append((count / max(1, count.sum())).astype(np.float32))
    return np.cumsum(sizes), np.concatenate(buckets or [np.zeros(0, dtype=np.int64)]), np.concatenate(weights or [np.zeros(0, dtype=np.float32)])


def language_sample(docs: DataFrame, per_lang: int, parts: int = 4, part: int = 2, most_bytes: int = 8 << 20) -> list[tuple[str, str]]:
    """Whole texts of up to ``per_lang`` rows of each language, outside the held-out fold, by the order of a hash of the id; of each language those that fit into ``most_bytes``."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1 << 30, (2 * per_lang + 50) * (1 << 30) // n))).otherwise(limit)
    near = usable.select("doc_id", "lang").where(at <= limit)
    order = W.Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").collect()
    return [(t, lang) for _, t, lang in fitting_texts(usable, [(r.doc_id, r.lang) for r in ids], "string", most_bytes)]


def fit_language(docs: DataFrame, per_lang: int = 1000) -> LanguageModel:
    """Fit on at most ``per_lang`` texts of each language, outside the held-out fold."""
    return LanguageModel.fit(language_sample(docs, per_lang))


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "_lang") -> DataFrame:
    """``docs`` with a struct column ``into``: lang_pred, score, rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, F.arrow_udf(lambda t, shared=shared: shared.value.predict(t), RESULT)(F.col(text_col)))
