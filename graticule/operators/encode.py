"""Encoders as DataFrame plans. The relational ones stay in one row (no explode, no shuffle) and JVM-side; the
batch ones run the numpy twins over Arrow batches and are the faster choice for large images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encoders as E
from ..functions import geometry as G
from ..functions.batches import with_batch_column
from ..functions.binding import let
from ..functions.similarity import similarity
from ..schemas import EVENT, WORD


def _constant(rows: list[list[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(i) for i in row]) if row else F.array().cast("array<int>") for row in rows])


def pool_sums(pixels: Column, members: list[list[int]]) -> Column:
    """The sum of the pixels of each cell."""
    return F.transform(_constant(members), lambda cell: F.aggregate(cell, F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(pixels, i)))


def total(pixels: Column) -> Column:
    return F.aggregate(pixels, F.lit(0).cast("bigint"), lambda acc, p: acc + p)


def image_mean(pixels: Column) -> Column:
    return total(pixels).cast("double") / F.size(pixels)


def word(flags: Column) -> Column:
    """Up to 48 booleans as the bits of a word."""
    bits = F.transform(flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))


def event_of(flags: Column) -> Column:
    """``event`` of booleans that take work to compute."""
    return let(flags, event)


def event(flags: Column) -> Column:
    """Up to 96 booleans as an event."""
    return F.struct(word(F.slice(flags, 1, WORD)).alias("lo"), word(F.slice(flags, WORD + 1, WORD)).alias("hi"))


def _reached(sums: Column, counts: list[int], threshold: Column) -> Column:
    cells = F.arrays_zip(sums.alias("s"), F.array(*[F.lit(n) for n in counts]).alias("n"))
    return F.transform(cells, lambda c: (c["n"] > 0) & (c["s"] != 0) & (c["s"].cast("double") / F.greatest(F.lit(1), c["n"]) >= threshold))


def encode_images(samples: DataFrame, rows: int, columns: int, multiplier: float = 1.0, into: str = "event") -> DataFrame:
    """``samples`` of one size with their pool-threshold event."""
    factor = E.check_multiplier(multiplier)
    high, wide = G.grid_shape(rows, columns)
    members = G.members(G.grid_cells(rows, columns), high * wide)
    counts = [len(m) for m in members]
    found = lambda pixels: let(image_mean(pixels) * F.lit(factor), lambda cut: event_of(_reached(pool_sums(pixels, members), counts, cut)))
    return samples.withColumn(into, let(F.col("pixels"), found))


def encode_tiles(samples: DataFrame, into: str = "tiles") -> DataFrame:
    """28x28 ``samples`` with the array of their four tile events."""
    members = [G.members(G.tile_cells(tile), G.TILE_ROWS * G.TILE_COLUMNS) for tile in range(4)]

    def tile(pixels: Column, mean: Column, cells: list[list[int]]) -> Column:
        counts = [len(x) for x in cells]
        return let(pool_sums(pixels, cells), lambda sums: F.struct(*[word(_reached(sums, counts, mean * f)).alias(name) for name, f in (("lo", G.TILE_LOW), ("hi", G.TILE_HIGH))]))

    events = lambda pixels: let(image_mean(pixels), lambda mean: F.array(*[tile(pixels, mean, m) for m in members]))
    return samples.withColumn(into, let(F.col("pixels"), events))


def patch_events(samples: DataFrame, into: str = "patches") -> DataFrame:
    """28x28 ``samples`` with the array of 16 events of their lit patch pixels."""
    starts = [(r * G.PATCH) * G.SIDE + c * G.PATCH for r in range(G.PATCHES) for c in range(G.PATCHES)]
    members = [[s + r * G.SIDE + c for r in range(G.PATCH) for c in range(G.PATCH)] for s in starts]

    def events(pixels: Column, cut: Column) -> Column:
        lit = lambda i: (F.get(pixels, i).cast("double") >= cut) & (F.get(pixels, i) != 0)
        return F.transform(_constant(members), lambda cell: event_of(F.transform(cell, lit)))

    return samples.withColumn(into, let(F.col("pixels"), lambda pixels: let(image_mean(pixels) * G.PATCH_FACTOR, lambda cut: events(pixels, cut))))


def detector_scores(patch: Column, kind: str = "iou") -> Column:
    """The best similarity of a patch event with the stored patterns of each detector."""
    bank: dict[int, list[tuple[int, int]]] = {}
    for d, _, bits in G.detector_bank():
        bank.setdefault(d, []).append(G.words_of(bits))
    best = [F.greatest(*[similarity(patch["lo"], patch["hi"], F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"), kind) for lo, hi in sorted(set(stored))]) for _, stored in sorted(bank.items())]
    return F.array(*best)


def encode_patches(samples: DataFrame, kind: str = "iou", cut: float = G.DETECTOR_CUT, into: str = "patch") -> DataFrame:
    """28x28 ``samples`` with the event of their patch channel."""
    found = patch_events(samples, "_patches")
    flags = F.flatten(F.transform("_patches", lambda p: F.transform(detector_scores(p, kind), lambda s: s >= cut)))
    return found.withColumn(into, event_of(flags)).drop("_patches")


def encode_features(samples: DataFrame, ink: int = G.INK, kind: str = "iou", into: str = "features") -> DataFrame:
    """28x28 ``samples``, centred, with the array of their five channel events."""
    from .transform import center

    encoded = encode_patches(encode_tiles(center(samples, ink), "_tiles"), kind, into="_patch")
    return encoded.withColumn(into, F.concat("_tiles", F.array("_patch"))).drop("_tiles", "_patch")


def _matrix(pixels: pa.Array, size: int) -> np.ndarray:
    flat = pixels.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) != len(pixels) * size:
        raise ValueError("image dimensions do not match its pixel data")
    return flat.reshape(len(pixels), size)


def _events(values: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k])) for k in (0, 1)], names=["lo", "hi"])


def encode_images_batch(samples: DataFrame, rows: int, columns: int, multiplier: float = 1.0, into: str = "event") -> DataFrame:
    """As ``encode_images``, by numpy over Arrow batches."""
    E.check_multiplier(multiplier)
    run = lambda p: _events(E.encode_images(_matrix(p, rows * columns), rows, columns, multiplier))
    return with_batch_column(samples, into, EVENT, run, "pixels")


def encode_features_batch(samples: DataFrame, dx: Column | None = None, dy: Column | None = None, ink: int = G.INK, kind: str = "iou", into: str = "features") -> DataFrame:
    """As ``encode_features``, by numpy over Arrow batches, with an extra shift for each row."""

    def run(pixels: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        out = E.encode_features(_matrix(pixels, G.SIDE**2), x.to_numpy(), y.to_numpy(), ink, kind)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * len(out) + 1, 5), pa.int32()), _events(out.reshape(-1, 2)))

    zero = F.lit(0)
    shifted = samples.withColumns({"_dx": dx if dx is not None else zero, "_dy": dy if dy is not None else zero})
    return with_batch_column(shifted, into, T.ArrayType(EVENT), run, "pixels", "_dx", "_dy").drop("_dx", "_dy")
