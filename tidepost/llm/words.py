"""Hashes of the words of whole texts, computed on the bytes of an Arrow column.

A word is a run of bytes between ASCII white space (9 to 13 and 32). Work goes through a text column in pieces of about a
megabyte, so memory stays bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
EMPTY = np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(seed: int, count: int) -> np.ndarray:
    """``count`` odd 64-bit constants that follow from ``seed``."""
    start = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    with np.errstate(over="ignore"):
        return mixed(start + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_VALUE = np.where(IS_SPACE, np.uint64(0), constants(1, 256))
SHINGLE_FACTORS = constants(2, 64)
_STEP = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    """Powers of one odd constant modulo 2**64, at least ``count`` of them."""
    global _powers
    if len(_powers) < count:
        steps = np.full(max(count, 4096), _STEP, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``PIECE_BYTES`` together; a longer text is a piece of its own."""
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE_BYTES, "right")) - 1)
        yield data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and for each text (and the end) the number of words before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~IS_SPACE[data]
    after = np.empty(len(data), bool)
    after[0] = True
    after[1:] = ~solid[:-1]
    after[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(solid & after)
    return starts, np.searchsorted(starts, at)


def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each start to the next; white space carries 0."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return EMPTY
    first = starts[0]
    begin = starts - first
    place = np.arange(len(data) - first) - np.repeat(begin, np.diff(np.append(begin, len(data) - first)))
    return mixed(np.add.reduceat(BYTE_VALUE[data[first:]] * powers(int(place.max()) + 1)[place], begin))


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words.

    A text of fewer words has one run, of all its words; a text without words has none.
    """
    full = EMPTY
    if len(hashes) >= size:
        full = np.zeros(len(hashes) - size + 1, np.uint64)
        for i in range(size):
            full += hashes[i : len(hashes) - size + 1 + i] * SHINGLE_FACTORS[i]
        full = mixed(full)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            short = np.add.reduce(hashes[a:b] * SHINGLE_FACTORS[: b - a], dtype=np.uint64)
            yield mixed(np.array([short ^ np.uint64(b - a)], np.uint64))
        else:
            yield EMPTY


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of every text of a column, in order."""
    for data, at in pieces(*text_bytes(column)):
        starts, bounds = word_starts(data, at)
        yield from shingle_sets(word_hashes(data, starts), bounds, size)
