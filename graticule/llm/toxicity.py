"""Toxicity by a factorization machine over hashed terms (operator 7).

Terms are the words of a text and the first five bytes of longer words, hashed into buckets. The buckets
whose presence tells most about the labels of the training sample become features, and so do both members of
every pair whose joint presence does and tells more than either alone; the machine adds their weights and,
through low-rank factors, a weight for every pair that occurs together, which an additive model lacks. Its sum
goes through a logistic curve.

Defined results: null and empty texts have no features and get the score of the bias; without labelled rows
of both classes every score is 0.5; texts of any length are read whole; repeated words count once, repeated rows and
texts that tie get equal scores; an empty table gives an empty result; other columns pass through unread, but one
named as ``into`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import labelled_sample
from .textops import ALNUM_WORDS, U64, mix, shingle_set, slices, words
from .workspace import small_batches

BUCKETS = 1 << 20
PREFIX = 5


@dataclass
class FactorizationMachine:
    """slots: the feature of each bucket, -1 for none; bias, linear weights and factors."""

    slots: np.ndarray | None = None
    bias: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], features: int = 256, least_odds: float = 2.0, least_chi: float = 45.0, rank: int = 8, epochs: int = 30, seed: int = 7) -> FactorizationMachine:
        """Choose features by their chi-square with the label and by that of their pairs, then minimise the logistic loss by AdaGrad."""
        sample = _without_copies(sample)
        y = np.array([label for _, label in sample], dtype=np.float64)
        if not len(y) or y.min() == y.max():
            return cls()
        pairs = np.concatenate([row.astype(np.int64) + (i << 20) for i, row in enumerate(_rows(pa.array([t for t, _ in sample]), None))] or [np.zeros(0, dtype=np.int64)])
        doc, bucket = pairs >> 20, pairs & (BUCKETS - 1)
        n = len(y)
        have = np.bincount(bucket, minlength=BUCKETS).astype(np.float64)
        positive = np.bincount(bucket, weights=y[doc], minlength=BUCKETS)
        expected = have * y.mean()
        chi = np.where(have >= 3, (positive - expected) ** 2 * n / np.maximum(1.0, expected * (n - have)), 0.0) * (1 / max(1e-9, 1 - y.mean()))
        share = lambda hits, of: (hits + 0.5) / (of + 1.0)
        odds = np.log(share(positive, y.sum()) / share(have - positive, n - y.sum()))
        chi[np.abs(odds) < least_odds] = 0  # present in long texts of either label, and so a measure of length
        chosen = np.argsort(-chi, kind="stable")[:features]
        chosen = np.sort(chosen[chi[chosen] > least_chi])
        chosen = np.union1d(chosen, _pair_members(doc, bucket, y, have, positive, least_odds, least_chi))
        model = cls(np.full(BUCKETS, -1, dtype=np.int32))
        model.slots[chosen] = np.arange(len(chosen))
        kept = model.slots[bucket] >= 0
        doc, feature = doc[kept], model.slots[bucket[kept]].astype(np.int64)
        model._train(doc, feature, y, odds[chosen], rank, epochs, np.random.default_rng(seed))
        return model

    def _train(self, doc, feature, y, odds, rank, epochs, rng, batch=64, rate=0.1, decay=1e-5):
        """Start from the features' log odds, so that a term too rare to move by gradient steps keeps its say."""
        n_features = len(odds)
        first = np.searchsorted(doc, np.arange(len(y) + 1))
        w, v, b = odds.copy(), rng.normal(0, 0.05, (n_features, rank)), 0.0
        gw, gv, gb = np.full(n_features, 1e-6), np.full((n_features, rank), 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                sizes = first[rows + 1] - first[rows]
                own = np.repeat(np.arange(len(rows)), sizes)
                f = feature[np.repeat(first[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
                x = np.zeros((len(rows), n_features))
                x[own, f] = 1.0
                sums = x @ v
                z = b + x @ w + 0.5 * (sums**2 - x @ (v**2)).sum(axis=1)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]
                db, dw = error.mean(), x.T @ error / len(rows) + decay * w
                dv = (x.T @ (error[:, None] * sums) - (x.T @ error)[:, None] * v) / len(rows) + decay * v
                gb += db * db
                gw += dw * dw
                gv += dv * dv
                b -= rate * db / np.sqrt(gb)
                w -= rate * dw / np.sqrt(gw)
                v -= rate * dv / np.sqrt(gv)
        self.bias, self.linear, self.factors = float(b), w, v

    def score(self, texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), 0.5)
        if self.slots is None:
            return pa.array(out)
        for i, row in enumerate(_rows(texts, self.slots)):
            f = self.slots[row]
            z = self.bias
            if len(f):
                v = self.factors[f]
                z += self.linear[f].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
            out[i] = 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))
        return pa.array(out)


def _pair_members(doc, bucket, y, have, positive, least_odds: float, least_chi: float, block: int = 1024) -> np.ndarray:
    """The buckets of the pairs that pass both bounds and whose share of a label also departs by ``least_chi`` from that of either member.

    Buckets in too few texts of a label for any of their pairs to reach ``least_chi`` are left out, which loses none.
    """
    n, mean = len(y), y.mean()
    reach = lambda hits, share: hits * n * (1 - share) > least_chi * share * (n - hits)
    able = np.flatnonzero(reach(positive, mean) | reach(have - positive, 1 - mean))
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[able] = np.arange(len(able))
    doc, term = doc[place[bucket] >= 0], place[bucket[place[bucket] >= 0]]
    doc, term = (a[np.argsort(term, kind="stable")] for a in (doc, term))
    share, toxic = (positive / np.maximum(1, have))[able], y > 0
    picked = np.zeros(len(able), dtype=bool)

    def present(at: int) -> np.ndarray:
        a, b = np.searchsorted(term, (at, at + block))
        x = np.zeros((n, min(block, len(able) - at)), dtype=np.float32)
        x[doc[a:b], term[a:b] - at] = 1
        return x

    for i in range(0, len(able), block):
        left = present(i)
        for j in range(i, len(able), block):
            right = left if i == j else present(j)
            p, q = left[toxic].T @ right[toxic], left[~toxic].T @ right[~toxic]
            c, own, other = p + q, share[i : i + block, None], share[None, j : j + block]
            chi = (p - c * mean) ** 2 * n / np.maximum(1e-9, c * mean * (1 - mean) * (n - c))
            x, z = np.nonzero((chi > least_chi) & (c < n))
            p, c, own, other = p[x, z], c[x, z], own[x, 0], other[0, z]
            odds = np.log((p + 0.5) / (toxic.sum() + 1.0) / ((c - p + 0.5) / (n - toxic.sum() + 1.0)))
            alone = np.where(odds > 0, np.maximum(own, other), np.minimum(own, other))
            more = (p - c * alone) * np.sign(odds) > np.sqrt(least_chi * c * alone * (1 - alone))
            use = (np.abs(odds) >= least_odds) & more
            picked[i + x[use]] = True
            picked[j + z[use]] = True
    return able[picked]


def _without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The texts whose least five-word shingles, by two orders, no earlier text has: copies would make all their words look telling."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in sample:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        own = shingle_set(words(data, np.array([0, len(data)]), ALNUM_WORDS).hashes, 5)
        least = {(k, int(mix(own ^ U64(k)).min())) for k in (1, 2)} if len(own) else set()
        if not least & seen:
            out.append((text, y))
        seen |= least
    return out


def _rows(texts: pa.Array, slots: np.ndarray | None):
    """The distinct buckets of each text, of those that have a slot if given."""
    for _, data, offsets in slices(texts):
        w = words(data, offsets, ALNUM_WORDS)
        count = len(w.hashes)
        prefix = w.prefix_hashes(PREFIX)
        bucket = (np.concatenate([w.hashes, prefix]) & U64(BUCKETS - 1)).astype(np.int64)
        row = np.searchsorted(w.first, np.arange(count), side="right") - 1
        row = np.concatenate([row, row])
        used = np.concatenate([np.ones(count, dtype=bool), prefix != 0])
        if slots is not None:
            used &= slots[bucket] >= 0
        pairs = np.unique((row[used] << 20) | bucket[used])
        cut = np.searchsorted(pairs, np.arange(len(offsets)) << 20)
        for a, b in zip(cut[:-1], cut[1:]):
            yield pairs[a:b] & (BUCKETS - 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> FactorizationMachine:
    """Fit on at most ``per_class`` labelled texts of each class, outside the held-out fold."""
    return FactorizationMachine.fit(labelled_sample(docs, labels, "toxic", per_class))


def with_toxicity(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1, higher for label 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, F.arrow_udf(lambda t, shared=shared: shared.value.score(t), T.DoubleType())(F.col(text_col)))
