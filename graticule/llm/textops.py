"""Vectorised work on the UTF-8 bytes of whole Arrow string columns: words, hashes and windows.

Texts are taken in slices of about ``SLICE`` bytes, so memory follows the longest single text and
not the batch. Both word definitions used here are decided by ASCII bytes alone, so bytes of longer
UTF-8 sequences never start or end a word by themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64


def _rule(separators: str) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for byte in range(256):
        table[byte] = not (byte < 128 and eval_class(byte, separators))
    return table


def eval_class(byte: int, name: str) -> bool:
    """Whether an ASCII byte (A-Z already lower-cased) separates words."""
    if name == "space":
        return byte == 0x20 or 0x09 <= byte <= 0x0D
    return not (0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A)


#: Bytes that belong to words: runs of anything but ASCII white space, or of letters, digits and all non-ASCII.
SPACE_WORDS = _rule("space")
ALNUM_WORDS = _rule("alnum")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and multiply, three rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_KEYS = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Weights of the places of a window of words.
PLACES = mix(np.arange(7, 7 + 64, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)
LANE, LANES = 8, 2
#: By the number of bytes of a lane that count, the mask of those bytes of a little-endian word.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(LANE + 1)], dtype=U64)


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        column = column.fill_null("")
        yield from slices(column, size)
        return
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """The words of a slice: hashes, byte bounds, and for row ``i`` the words ``first[i]:first[i + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    lanes: np.ndarray

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes, at most a lane, of the words longer than ``n``; 0 for others."""
        long = self.ends - self.starts > n
        out = np.zeros(len(self.starts), dtype=U64)
        out[long] = mix((self.lanes[self.starts[long]] & MASKS[n]) ^ PLACES[63])
        return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Lower-case A-Z and take the words of each row.

    A word's hash is a chain of bijective mixes over its bytes, eight at a time, so words of up to eight bytes and
    one length never share a hash; a word of over ``LANES`` lanes has its BLAKE2 digest. No sum or polynomial of
    the bytes is involved, so no family of words collides by construction.
    """
    low = np.zeros(len(data) + LANE, dtype=np.uint8)
    low[: len(data)] = LOWER[data]
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=low, strides=(1,))
    inside = is_word[low[: len(data)]]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    lens = ends - starts
    hashes = mix((lanes[starts] & MASKS[np.minimum(lens, LANE)]) ^ mix(lens.astype(U64)))
    more = np.flatnonzero(lens > LANE)
    if len(more):
        left = lens[more] - LANE
        hashes[more] = mix(hashes[more] ^ (lanes[starts[more] + LANE] & MASKS[np.minimum(left, LANE)]))
        for k in more[left > LANE * (LANES - 1)]:
            hashes[k] = int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), lanes)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive words, over row borders too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * PLACES[0]
        for j in range(1, k):
            out += hashes[j : j + n] * PLACES[j % 60] + U64(j)
        return mix(out)


def shingle_set(row: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of one row's words; with fewer words the whole sequence is one."""
    if not len(row):
        return row
    return np.unique(windows(row, min(k, len(row))))
