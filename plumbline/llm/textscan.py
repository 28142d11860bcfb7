"""Vectorised word scanning over Arrow text columns.

``scan`` walks a column in slices of at most ``SLICE`` bytes (a longer text is a slice of its own)
and gives, for each slice, the words' document, place and 64-bit hash, without a Python object per
word.  A word is a maximal run of bytes that are not in ``SPACES``; ASCII capitals are lowered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_MUL = np.uint64(0x9E3779B97F4A7C15)

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        for i, base in enumerate((_MUL, np.uint64(pow(int(_MUL), -1, 1 << 64)))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def raw_texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its row offsets in them; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(offs: np.ndarray, most: int = SLICE):
    """Row ranges whose texts have at most ``most`` bytes together."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(buf: np.ndarray, offs: np.ndarray, fold: bool = True, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of each word in ``buf``, whose texts begin at ``offs`` and end at its end.

    A word never crosses from one text to the next.  ``cut`` marks bytes inside of words at which another begins.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = IS_WORD[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(buf)]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    last[tails] |= inside[tails]
    if cut is not None:
        first |= cut
        last[:-1] |= cut[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    length = end - start
    power, inverse = _powers(len(buf))
    with np.errstate(over="ignore"):
        sums = np.empty(len(buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_LOWER_CODES if fold else _CODES)[buf] * power[: len(buf)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inverse[start] + length.astype(np.uint64))
    return start, length, h
