"""Numpy kernels over the text buffers of Arrow batches, for use inside Spark tasks.

A batch of texts is one byte buffer with offsets. Words, their hashes and the hashes
of word windows are computed for all texts of a buffer at once, so the cost per byte
is a few array operations whatever the lengths of the texts. A buffer holds about
``CHUNK`` bytes (or one longer text), which bounds the temporaries.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = (1 << 19) - 64
U64 = np.uint64


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte class: True for the bytes in the inclusive ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = table((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACE
ALNUM = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LETTER = table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def whole(column: pa.ChunkedArray) -> pa.Array:
    """All chunks as one array; 64-bit offsets, so that texts of over 2 GB stay together."""
    return column.cast(pa.large_string()).combine_chunks()


def buffers(column: pa.Array, chunk: int = CHUNK):
    """Yield ``(first row, bytes, offsets)`` of runs of rows; a null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + chunk, "right")) - 1)
        yield low, whole[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Starts and ends of the maximal runs of ``inside`` bytes, none across two texts.

    Also the index of the first word of each text, with the total at the end.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ U64(seed)) * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below ``size``; base is odd."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int):
    size = 1 << max(16, int(n - 1).bit_length())
    up, down = _powers(base, size)
    return up[:n], down[:n]


_BYTE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def rolling(values: np.ndarray, starts, ends, base: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair; equal content, equal hash."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def hash_words(data, starts, ends, seed: int = 0) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U64)
    return mix(rolling(_BYTE[data], starts, ends, BASES[0]) + (ends - starts).astype(U64), seed)


def hash_windows(words: np.ndarray, length: int, base: int = BASES[1]) -> np.ndarray:
    """Hash of every ``length`` consecutive words of the buffer, mixed."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    starts = np.arange(n)
    return mix(rolling(words, starts, starts + length, base), length)


def rooms(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """True where a window of ``length`` words starting at word i ends in i's own text."""
    ok = np.zeros(n, bool)
    steps = np.zeros(n + 1, np.int64)
    low, high = first[:-1], np.maximum(first[1:] - length + 1, first[:-1])
    np.add.at(steps, low, 1)
    np.add.at(steps, high, -1)
    ok[:] = np.cumsum(steps[:-1]) > 0
    return ok


def owners(first: np.ndarray) -> np.ndarray:
    """Index of the text of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
