"""Grids, canonical patterns and the detector bank: small constants derived from rules."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from ..schemas import PAYLOAD, WORD

PATCH, PATCHES = 7, 4
TILE, TILE_ROWS, TILE_COLUMNS = 14, 6, 8
DETECTORS = 6
SIDE = 28
#: Tile factors, patch factor, detector cut, ink cut, expert limits, augmentation shifts as (x, y).
TILE_LOW, TILE_HIGH, PATCH_FACTOR = 0.70, 1.40, 0.85
DETECTOR_CUT = float(np.float32(0.16))
INK = 20
AUGMENT = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


@lru_cache
def grid_shape(rows: int, columns: int, payload: int = PAYLOAD) -> tuple[int, int]:
    """(rows, columns) of the pooling grid: as square as the image's aspect allows within the payload."""
    wide = max(1, min(payload, int(math.sqrt(payload * (columns / rows)))))
    return max(1, payload // wide), wide


@lru_cache
def grid_cells(rows: int, columns: int, payload: int = PAYLOAD) -> tuple[int, ...]:
    """The grid cell of each pixel, row-major."""
    high, wide = grid_shape(rows, columns, payload)
    return tuple(min(high - 1, r * high // rows) * wide + min(wide - 1, c * wide // columns) for r in range(rows) for c in range(columns))


def members(cells: tuple[int, ...], bins: int) -> list[list[int]]:
    """The pixels of each cell."""
    out: list[list[int]] = [[] for _ in range(bins)]
    for pixel, cell in enumerate(cells):
        if cell >= 0:
            out[cell].append(pixel)
    return out


@lru_cache
def tile_cells(tile: int) -> tuple[int, ...]:
    """The tile cell of each pixel of a 28x28 image; -1 outside the quadrant."""
    top, left = tile // 2 * TILE, tile % 2 * TILE
    inside = lambda r, c: top <= r < top + TILE and left <= c < left + TILE
    return tuple(
        (r - top) * TILE_ROWS // TILE * TILE_COLUMNS + (c - left) * TILE_COLUMNS // TILE if inside(r, c) else -1
        for r in range(SIDE) for c in range(SIDE)
    )


def pattern(detector: int, dx: int = 0, dy: int = 0) -> int:
    """A 7x7 canonical pattern as bits, moved and clipped.

    0 middle row, 1 middle column, 2 and 3 the diagonals, 4 the second row and column, 5 the outline
    without its upper right and lower left corners.
    """
    middle, last = PATCH // 2, PATCH - 1
    every = range(PATCH)
    border = {(r, c) for r in every for c in every if r in (0, last) or c in (0, last)}
    cells = (
        {(middle, i) for i in every},
        {(i, middle) for i in every},
        {(i, i) for i in every},
        {(i, last - i) for i in every},
        {(1, i) for i in every} | {(i, 1) for i in every},
        border - {(0, last), (last, 0)},
    )[detector]
    moved = ((r + dy, c + dx) for r, c in cells)
    return sum(1 << (r * PATCH + c) for r, c in moved if 0 <= r < PATCH and 0 <= c < PATCH)


@lru_cache
def detector_bank() -> tuple[tuple[int, int, int], ...]:
    """(detector, slot, bits): each pattern as it is and moved by one along either axis; the unmoved one is stored twice."""
    moves = [m for s in (-1, 0, 1) for m in ((s, 0), (0, s))]
    return tuple((d, slot, pattern(d, *move)) for d in range(DETECTORS) for slot, move in enumerate(moves))


def words_of(bits: int) -> tuple[int, int]:
    """(lo, hi) of up to 96 bits."""
    return bits & ((1 << WORD) - 1), bits >> WORD
