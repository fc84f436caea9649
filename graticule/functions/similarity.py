"""Bit-set similarities as Spark columns and as numpy functions. Scores lie in [0, 1]; two empty events score 0.

The scoring rule of the original prototype memories is not public, so these are this engine's own definitions:
``iou`` (default), ``agreement`` (share of equal payload bits, 0 if either is empty) and ``cosine``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PAYLOAD

NAMES = ("iou", "agreement", "cosine")


def ones(lo: Column, hi: Column) -> Column:
    return (F.bit_count(lo) + F.bit_count(hi)).cast("int")


def both(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return ones(a_lo.bitwiseAND(b_lo), a_hi.bitwiseAND(b_hi))


def similarity(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column, kind: str = "iou") -> Column:
    """Of two events as doubles."""
    if kind == "iou":
        return both(a_lo, a_hi, b_lo, b_hi) / F.greatest(F.lit(1), ones(a_lo.bitwiseOR(b_lo), a_hi.bitwiseOR(b_hi)))
    empty = (ones(a_lo, a_hi) == 0) | (ones(b_lo, b_hi) == 0)
    if kind == "agreement":
        value = (PAYLOAD - ones(a_lo.bitwiseXOR(b_lo), a_hi.bitwiseXOR(b_hi))) / F.lit(float(PAYLOAD))
    elif kind == "cosine":
        value = both(a_lo, a_hi, b_lo, b_hi) / F.sqrt((F.greatest(F.lit(1), ones(a_lo, a_hi)) * F.greatest(F.lit(1), ones(b_lo, b_hi))).cast("double"))
    else:
        raise ValueError(f"unknown similarity: {kind}")
    return F.when(empty, F.lit(0.0)).otherwise(value)


def similarity_np(a: np.ndarray, b: np.ndarray, kind: str = "iou") -> np.ndarray:
    """Of events (..., 2), broadcast against each other."""
    count = lambda x: np.bitwise_count(x).sum(axis=-1).astype(np.float64)
    if kind == "iou":
        return count(a & b) / np.maximum(1.0, count(a | b))
    some = (count(a) > 0) & (count(b) > 0)
    if kind == "agreement":
        return np.where(some, (PAYLOAD - count(a ^ b)) / PAYLOAD, 0.0)
    if kind == "cosine":
        return np.where(some, count(a & b) / np.sqrt(np.maximum(1.0, count(a)) * np.maximum(1.0, count(b))), 0.0)
    raise ValueError(f"unknown similarity: {kind}")
