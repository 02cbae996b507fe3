"""Words of Arrow text columns as 64-bit hashes, whole blocks of documents at a time.

A word is a run of bytes that are not ASCII white space. Every word gets a polynomial hash of its
bytes (random byte values, odd multiplier, modulo 2**64, then mixed), taken from one running sum
over the block, so no Python object is made for a word. Equal words have equal hashes in every task
and session; two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text for which arrays are made at once; a longer document makes a block of its own.
BLOCK_BYTES = 500_000

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_MULTIPLIER = 0xD6E8FEB86659FD93
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer), another one for each seed."""
    with np.errstate(over="ignore"):
        x = values.astype(_U, copy=True)
        x += _U((_STEP * (seed + 1)) & (2**64 - 1))
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BYTE_VALUES = mix(np.arange(256, dtype=_U), 7)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(size, _MULTIPLIER, dtype=_U)
        down = np.full(size, _INVERSE, dtype=_U)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row starts within the bytes) for runs of about size bytes; null: empty."""
    for chunk_start, chunk in _chunks(column):
        if not len(chunk):
            continue
        chunk = chunk.cast(pa.large_binary()) if not pa.types.is_large_binary(chunk.type) else chunk
        if chunk.null_count:
            chunk = chunk.fill_null(b"")
        _, offsets, data = chunk.buffers()
        starts = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < len(chunk):
            last = int(np.searchsorted(starts, starts[first] + size, side="right")) - 1
            last = min(max(last, first + 1), len(chunk))
            yield chunk_start + first, chunk_start + last, raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
            first = last


def _chunks(column):
    start = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield start, chunk
        start += len(chunk)


def word_bounds(data: np.ndarray, starts: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, words before each row and in all) of a block."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(space[data], out=inside[:-1])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:]
    begin = np.flatnonzero(opens)
    closes = np.zeros(len(data) + 1, dtype=bool)
    closes[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    end = np.flatnonzero(closes)
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for every word of the block, words before each row and in all)."""
    begin, end, rows = word_bounds(data, starts, space)
    size = max(BLOCK_BYTES + 1, len(data) + 1)
    up, down = _powers(1 << (size - 1).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=_U)
        value = (_LOWER_VALUES if lower else _BYTE_VALUES)[data]
        value *= up[: len(data)]
        np.cumsum(value, out=total[1:])
        return mix((total[end] - total[begin]) * down[begin]), rows


def grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of n words that lies in one row, runs before each row and in all)."""
    counts = np.maximum(np.diff(rows) - (n - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if not offsets[-1]:
        return np.zeros(0, dtype=_U), offsets
    at = np.arange(offsets[-1]) + np.repeat(rows[:-1] - offsets[:-1], counts)
    with np.errstate(over="ignore"):
        value = np.zeros(len(at), dtype=_U)
        for k in range(n):
            value = value * _U(_MULTIPLIER) + words[at + k]
        return mix(value, n), offsets
