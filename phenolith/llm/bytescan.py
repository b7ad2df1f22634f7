"""Numpy kernels over the UTF-8 bytes of Arrow string columns: words, hashes, windows.

All of them take many texts at once as one byte buffer with offsets, so that the cost
per word is that of a few vector operations.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer text is handled alone.
BATCH_BYTES = 2 << 20
BLOCK = 1 << 20
SPACES = [9, 10, 11, 12, 13, 32]
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACES] = True


def _byte_values(fold: bool) -> np.ndarray:
    values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


EXACT, FOLDED = _byte_values(False), _byte_values(True)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_held: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    if base not in _held:
        _held[base] = _powers(base, BLOCK + 1)
    return _held[base]


def power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at mod 2**64 for any positions."""
    low = powers(base)[at % BLOCK]
    high = at // BLOCK
    if not high.size or not high.max():
        return low
    return low * _powers(pow(base, BLOCK, 1 << 64), int(high.max()) + 1)[high]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into runs of rows with about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = utf8(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row of each."""
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = at[:-1], at[1:]
    full = ends > begins
    first[begins[full]] |= inside[begins[full]]
    last[ends[full] - 1] |= inside[ends[full] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the same bytes give the same hash anywhere."""
    sums = [np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)]
    carry, scale, step = np.uint64(0), 1, pow(P, BLOCK, 1 << 64)
    for begin in range(0, len(data), BLOCK):
        part = data[begin : begin + BLOCK]
        total = np.cumsum(values[part] * powers(P)[: len(part)], dtype=np.uint64) * np.uint64(scale)
        total = np.concatenate([[carry], total + carry])
        for where, out in ((starts, sums[0]), (ends, sums[1])):
            a, b = np.searchsorted(where, [begin, begin + len(part) + (begin + BLOCK >= len(data))])
            out[a:b] = total[where[a:b] - begin]
        carry, scale = total[-1], scale * step & 0xFFFFFFFFFFFFFFFF
    return mix((sums[1] - sums[0]) * power_at(P_INV, starts) + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and the index of each run's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = (total + hashes[k : len(hashes) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    return mix(total[at]), at


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte windows of one buffer of at most BLOCK bytes."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(EXACT[data] * powers(P)[: len(data)], dtype=np.uint64)])
    return mix((total[k:] - total[:-k]) * powers(P_INV)[: len(data) - k + 1])


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Spans of data as one binary column."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[index])])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def process_held(key: object) -> dict:
    """A dictionary that lives as long as the Python worker, so that its later tasks find it again."""
    module = sys.modules.setdefault("_held_by_process", types.ModuleType("_held_by_process"))
    return module.__dict__.setdefault("held", {}).setdefault(key, {})
