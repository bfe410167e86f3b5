"""Numpy kernels over the buffers of an Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The six ASCII white-space bytes.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII letters and digits, and all bytes of longer characters.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True
IS_LETTER = IS_WORD.copy()
IS_LETTER[48:58] = False

BASE = np.uint64(0x9E3779B97F4A7C15)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the n+1 offsets of rows in them, from 0; a null row is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the power 0 .. n-1, modulo 2**64; kept for short lengths."""
    global _powers
    if n > len(_powers):
        grown = np.full(max(1 << 16, n), BASE, dtype=np.uint64)
        grown[0] = 1
        grown = np.cumprod(grown, dtype=np.uint64)
        if len(grown) > 1 << 22:
            return grown[:n]
        _powers = grown
    return _powers[:n]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of bytes that `inside` marks, and the row of each; none crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flags = inside[data]
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    row_starts = offsets[:-1][(offsets[1:] > offsets[:-1])]
    first[row_starts] = flags[row_starts]
    last = flags.copy()
    last[:-1] &= ~flags[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends - starts + 1, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int(lengths.max())
    total = int(lengths.sum())
    begins = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(begins, lengths)
    at = within + np.repeat(starts, lengths)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * powers(longest)[within]
    return mix(np.add.reduceat(value, begins) + lengths.astype(np.uint64))
