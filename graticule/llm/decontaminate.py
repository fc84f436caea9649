"""Benchmark decontamination by winnowed word k-grams (operator 9).

Fingerprints are the smallest hash among every ``SPAN`` consecutive ``K``-grams of words, so two texts
that share ``K + SPAN - 1`` = 13 words share a fingerprint at the same place of the shared span. Both sides are
winnowed and their fingerprints joined; a bitmap of bounded size keeps most of those at home that no item has.
Each hit is extended: the texts that have one meet their items, the 13-word windows of both are compared by hash,
and every match is confirmed on the words themselves. Items of fewer than 13 words are one window of their whole
length; these lie below the guarantee, and all windows of their lengths are looked up.

Texts go by their SHA-256, so copies are judged once and hold up no task, and only texts with a common fingerprint are
moved. The benchmark may be of any size: it is a table of the join, not a broadcast.

Defined results: null and empty texts have no words and no hits; null or empty items hit nothing; items
with a null id still mark words, but are not listed; repeated items count once; repeated documents each
get their row; texts of any length are read whole, one at a time in memory; nothing depends on an order, so ties
do not arise; an empty table gives an empty result, an empty benchmark no hits; other columns pass through unread,
whatever their names, except that the result takes the place of a column named as ``into``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .idfilter import Near, maybe_in
from .textops import ALNUM_WORDS, U64, slices, windows, words
from .workspace import materialize, unused

WINDOW = 13
K = 5
SPAN = WINDOW - K + 1
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def winnow(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, k: int = K) -> np.ndarray:
    """Positions of the chosen k-grams: of each window of words inside one row the smallest hash, the last of equals."""
    grams = windows(hashes, k)
    span = window - k + 1
    if len(grams) < span:
        return np.zeros(0, dtype=np.int64)
    start = np.arange(len(grams) - span + 1)
    row = np.searchsorted(first, start, side="right") - 1
    start = start[start + window <= first[row + 1]]
    if not len(start):
        return start
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    low = view[:, span - 1].copy()
    at = np.full(len(view), span - 1, dtype=np.int64)
    for j in range(span - 2, -1, -1):
        less = view[:, j] < low
        low[less] = view[less, j]
        at[less] = j
    return np.unique(start + at[start])


def _prints(data: np.ndarray, offsets: np.ndarray, sizes: list[int]):
    """(row, window size, fingerprint) of the rows of a slice: winnowed 5-grams for 13, whole windows for smaller ``sizes``."""
    w = words(data, offsets, ALNUM_WORDS)
    for size in sizes:
        if size == WINDOW:
            at = winnow(w.hashes, w.first)
            prints = windows(w.hashes, K)[at]
        else:
            prints = windows(w.hashes, size)
            at = np.arange(len(prints))
        row = np.searchsorted(w.first, at, side="right") - 1
        inside = at + (K if size == WINDOW else size) <= w.first[row + 1]
        yield row[inside], size, (prints[inside] ^ U64(size)).view(np.int64)


PRINTS = "h binary, size int, fp bigint"


def fingerprints(texts: DataFrame, sizes: list[int] | None = None, near: Near | None = None) -> DataFrame:
    """PRINTS of the rows (h, t). sizes: of the windows; where not given, 13, or all words of a shorter text. near: leaves out most of those that no item has."""

    def run(batches):
        for batch in batches:
            hs = batch.column("h")
            for base, data, offsets in slices(batch.column("t")):
                if sizes is None:
                    first = words(data, offsets, ALNUM_WORDS).first
                    lengths = np.minimum(np.diff(first), WINDOW)
                    found = [(r, s, f) for r, s, f in _prints(data, offsets, sorted({int(n) for n in lengths if n}))]
                    found = [(r[lengths[r] == s], s, f[lengths[r] == s]) for r, s, f in found]
                else:
                    found = _prints(data, offsets, sizes)
                for row, size, prints in found:
                    if near and len(row):
                        some = near.test(prints)
                        row, prints = row[some], prints[some]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([hs.take(pa.array(base + row)), pa.array(np.full(len(row), size, dtype=np.int32)), pa.array(np.ascontiguousarray(prints))], names=["h", "size", "fp"])

    return texts.select("h", "t").mapInArrow(run, PRINTS)


HITS = "h binary, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, hits binary, items array<string>"


class _Text:
    """The words of one text, and the places of its windows by hash, made once a size."""

    def __init__(self, text: bytes):
        self.words = WORD.findall(text.lower())  # of bytes, so A-Z only
        self.hashes = words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), ALNUM_WORDS).hashes
        self.order: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.order:
            grams = windows(self.hashes, size)
            at = np.argsort(grams, kind="stable")
            self.order[size] = grams[at], at
        return self.order[size]

    def occurrences(self, item: _Text) -> tuple[np.ndarray, int]:
        """Starts of the windows of ``item`` in this text, and their length."""
        size = min(len(item.words), WINDOW)
        if not size or size > len(self.words):
            return np.zeros(0, dtype=np.int64), size
        grams, at = self.windows(size)
        own, first = item.windows(size)
        low, high = np.searchsorted(grams, own, side="left"), np.searchsorted(grams, own, side="right")
        starts = {int(p) for a, b, i in zip(low, high, first) if b > a for p in at[a:b] if self.words[p : p + size] == item.words[i : i + size]}
        return np.array(sorted(starts), dtype=np.int64), size


def extend(met: DataFrame) -> DataFrame:
    """HITS of each text. met: (h, item, t, ids), for each h the text (item 0) and then its items."""

    def run(batches):
        h = text = mask = None
        names: set[str] = set()
        for batch in batches:
            out = []
            for key, item, t, ids in zip(batch.column("h").to_pylist(), batch.column("item").to_pylist(), batch.column("t"), batch.column("ids").to_pylist()):
                if key != h:
                    if text is not None:
                        out.append(row(h, text, mask, names))
                    h, text, names = key, _Text(bytes(t.as_buffer())), set()
                    mask = np.zeros(len(text.words) + 1, dtype=np.int64)
                elif item:
                    starts, size = text.occurrences(_Text(bytes(t.as_buffer())))
                    if len(starts):
                        np.add.at(mask, starts, 1)
                        np.add.at(mask, starts + size, -1)
                        names.update(i for i in ids if i is not None)
            if out:
                yield emit(out)
        if text is not None:
            yield emit([row(h, text, mask, names)])

    def row(h, text, mask, names):
        hit, listed = np.cumsum(mask)[:-1] > 0, sorted(names)
        n_hit = int(hit.sum())
        return h, len(text.words), n_hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), np.packbits(hit).tobytes() if n_hit else b"", listed

    def emit(rows):
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in HITS.split(", ")])

    return met.mapInArrow(run, HITS)


def _digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def hit_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """HITS of the distinct texts of ``docs`` that share a fingerprint with the benchmark, as a written table; n_hit may be 0."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(_digest(F.col(item_text)).alias("h"), F.col(item_text).alias("t"), F.col(item_id).cast("string").alias("i"))
    items = materialize(items.groupBy("h").agg(F.min("t").alias("t"), F.collect_set("i").alias("ids")), "bench-items")
    prints = materialize(fingerprints(items).distinct(), "bench-prints")
    sizes = sorted(r.size for r in prints.select("size").distinct().collect())
    texts = docs.select(_digest(F.col(text_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    own = fingerprints(texts, sizes, maybe_in(prints.select("fp")))
    pairs = own.join(prints.withColumnRenamed("h", "ih"), ["size", "fp"]).select("h", "ih").distinct()
    pairs = materialize(pairs, "bench-pairs")
    wanted = pairs.select("h").distinct()
    key = F.xxhash64("h")
    near = maybe_in(wanted.select(key.alias("id")))
    some = (texts.where(near(key)) if near else texts).join(wanted, "h", "left_semi").groupBy("h").agg(F.min("t").alias("t"))
    none = F.lit(None).cast("array<string>")
    met = some.select("h", F.lit(0).alias("item"), "t", none.alias("ids")).unionAll(pairs.join(items.withColumnRenamed("h", "ih"), "ih").select("h", F.lit(1).alias("item"), "t", "ids"))
    return materialize(extend(met.repartition("h").sortWithinPartitions("h", "item")), "bench-hits")


def count_words(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *[np.diff(words(data, offsets, ALNUM_WORDS).first) for _, data, offsets in slices(texts)]]))

    return F.arrow_udf(run, T.LongType())(text)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "_hits") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, n_items, items_sha256, hits (a bit per word), items."""
    found = hit_texts(docs, benchmark, text_col, item_id, item_text)
    key = unused(docs, "h")
    told = found.select(F.col("h").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in ("n_hit", "n_items", "items_sha256", "hits", "items")])
    counted = docs.withColumns({key: _digest(F.col(text_col)), f"{key}_n": count_words(F.col(text_col))})
    nothing = {"n_hit": F.lit(0).cast("bigint"), "n_items": F.lit(0).cast("bigint"), "items_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "hits": F.lit(b""), "items": F.array().cast("array<string>")}
    state = F.struct(F.col(f"{key}_n").alias("n_words"), *[F.coalesce(F.col(f"{key}_{c}"), v).alias(c) for c, v in nothing.items()])
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()]
    return counted.join(told, key, "left").select(*others, state.alias(into))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lie inside benchmark windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = hit_texts(docs, benchmark, text_col, item_id, item_text)
    key = unused(docs, "h")
    bad = found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("h").alias(key))
    return docs.join(bad, _digest(F.col(text_col)) == F.col(key), "left_anti")
