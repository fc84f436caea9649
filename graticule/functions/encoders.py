"""Encoders over whole batches of images in numpy: the volume path, equal bit for bit to the relational one."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from ..schemas import PAYLOAD, WORD
from . import geometry as G
from .similarity import similarity_np


def check_multiplier(multiplier: float) -> float:
    """The multiplier as it acts: rounded to 32 bits, then widened."""
    if not math.isfinite(multiplier) or not multiplier > 0:
        raise ValueError("threshold multiplier must be finite and positive")
    return float(np.float32(multiplier))


@lru_cache
def _pool(cells: tuple[int, ...], bins: int) -> tuple[np.ndarray, np.ndarray]:
    table = np.zeros((len(cells), bins))
    for pixel, cell in enumerate(cells):
        if cell >= 0:
            table[pixel, cell] = 1
    return table, table.sum(axis=0)


def pack(flags: np.ndarray) -> np.ndarray:
    """Booleans (n, up to 96) as events (n, 2)."""
    wide = np.zeros((len(flags), PAYLOAD), dtype=np.int64)
    wide[:, : flags.shape[1]] = flags
    weights = np.int64(1) << np.arange(WORD, dtype=np.int64)
    return np.stack([wide[:, :WORD] @ weights, wide[:, WORD:] @ weights], axis=1)


def encode_images(pixels: np.ndarray, rows: int, columns: int, multiplier: float = 1.0) -> np.ndarray:
    """Pool-threshold events (n, 2) of images (n, rows * columns)."""
    factor = check_multiplier(multiplier)
    if rows < 1 or columns < 1 or pixels.ndim != 2 or pixels.shape[1] != rows * columns:
        raise ValueError("image dimensions do not match its pixel data")
    high, wide = G.grid_shape(rows, columns)
    table, counts = _pool(G.grid_cells(rows, columns), high * wide)
    sums = pixels @ table
    threshold = pixels.sum(axis=1) / (rows * columns) * factor
    mean = sums / np.maximum(1, counts)
    return pack((counts > 0) & (sums != 0) & (mean >= threshold[:, None]))


def center(pixels: np.ndarray, dx: np.ndarray | int = 0, dy: np.ndarray | int = 0, ink: int = G.INK, side: int = G.SIDE) -> np.ndarray:
    """Images (n, side * side) moved so that the ink's box is centred, then by (dx, dy); images without ink stay."""
    if pixels.ndim != 2 or pixels.shape[1] != side * side:
        raise ValueError(f"structured encoding requires {side}x{side} images")
    n = len(pixels)
    image = pixels.reshape(n, side, side)
    lit = image > ink
    out = np.zeros_like(image)
    by_row, by_column = lit.any(axis=2), lit.any(axis=1)
    some = by_row.any(axis=1)
    bounds = lambda f: (f.argmax(axis=1), side - 1 - f[:, ::-1].argmax(axis=1))
    (top, bottom), (left, right) = bounds(by_row), bounds(by_column)
    down = np.where(some, np.trunc((side - 1 - top - bottom) / 2).astype(int) + dy, 0)
    across = np.where(some, np.trunc((side - 1 - left - right) / 2).astype(int) + dx, 0)
    at = np.arange(side)
    r, c = at[None, :] - down[:, None], at[None, :] - across[:, None]
    ok = ((r >= 0) & (r < side))[:, :, None] & ((c >= 0) & (c < side))[:, None, :]
    out = np.where(ok, image[np.arange(n)[:, None, None], np.clip(r, 0, side - 1)[:, :, None], np.clip(c, 0, side - 1)[:, None, :]], 0)
    return out.reshape(n, side * side)


def encode_tiles(pixels: np.ndarray) -> np.ndarray:
    """Four tile events (n, 4, 2): 48 cells above 0.7 of the image mean, and 48 above 1.4."""
    mean = pixels.sum(axis=1) / pixels.shape[1]
    out = []
    for tile in range(4):
        table, counts = _pool(G.tile_cells(tile), G.TILE_ROWS * G.TILE_COLUMNS)
        sums = pixels @ table
        cell = sums / counts
        some = sums != 0
        out.append(np.stack([pack(some & (cell >= (mean * f)[:, None]))[:, 0] for f in (G.TILE_LOW, G.TILE_HIGH)], axis=1))
    return np.stack(out, axis=1)


@lru_cache
def _bank() -> np.ndarray:
    """(detectors, slots, 2)."""
    events = np.array([G.words_of(bits) for _, _, bits in G.detector_bank()], dtype=np.int64)
    return events.reshape(G.DETECTORS, -1, 2)


def lit_patches(pixels: np.ndarray) -> np.ndarray:
    """Patch events (n, 16, 2): pixels of each 7x7 patch at or above 0.85 of the image mean."""
    n = len(pixels)
    threshold = pixels.sum(axis=1) / pixels.shape[1] * G.PATCH_FACTOR
    lit = (pixels >= threshold[:, None]) & (pixels != 0)
    patches = lit.reshape(n, G.PATCHES, G.PATCH, G.PATCHES, G.PATCH).transpose(0, 1, 3, 2, 4).reshape(n * G.PATCHES**2, G.PATCH**2)
    return pack(patches).reshape(n, G.PATCHES**2, 2)


def encode_patches(pixels: np.ndarray, kind: str = "iou", cut: float = G.DETECTOR_CUT) -> np.ndarray:
    """The patch event (n, 2): bit patch * 6 + detector where the best stored pattern scores at least ``cut``."""
    patches, bank = lit_patches(pixels), _bank()
    flags = np.stack([similarity_np(patches[:, :, None, :], bank[d][None, None], kind).max(axis=2) >= cut for d in range(G.DETECTORS)], axis=2)
    return pack(flags.reshape(len(pixels), -1))


def encode_features(pixels: np.ndarray, dx: np.ndarray | int = 0, dy: np.ndarray | int = 0, ink: int = G.INK, kind: str = "iou") -> np.ndarray:
    """Five events (n, 5, 2) of the centred images: four tiles and the patch channel."""
    moved = center(pixels, dx, dy, ink)
    return np.concatenate([encode_tiles(moved), encode_patches(moved, kind)[:, None, :]], axis=1)
