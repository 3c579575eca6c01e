"""Word and shingle hashes of Arrow text columns, in numpy, block by block.

Words are runs of bytes other than ASCII white space; a shingle is five words, or all words of a
shorter text. Hashes are 64-bit and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown as blocks ask for them."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK)
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE))
    return _powers


class Spans:
    """Hashes of spans of one sequence; equal contents have equal hashes anywhere."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def row_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and row offsets of runs of rows; a run is at most a block, or one row."""
    data, at = text_buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        yield data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def shingle_blocks(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """For blocks of rows, the shingle hashes of each row in text order."""
    for data, at in row_blocks(column):
        yield _shingles(data, at)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of every word."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < len(data)]
    begins[cut] = inside[cut]  # a row begins a word even where the row before ends in one
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    stop = at[1:][at[1:] > 0] - 1
    closes[stop] = inside[stop]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, Spans(_BYTE[data])(starts, ends)


def _shingles(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    rows = len(at) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * rows
    starts, words = words_of(data, at)
    bounds = np.searchsorted(starts, at)
    total = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total += words[k : k + len(total)] * _PLACE[k]
    grams = mix(total)
    out = []
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - b >= SHINGLE:
            out.append(grams[b : e - SHINGLE + 1])
        elif e > b:
            out.append(mix(np.array([(words[b:e] * _PLACE[: e - b]).sum(dtype=np.uint64) + np.uint64(e - b)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
