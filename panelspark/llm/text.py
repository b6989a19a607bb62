"""Vectorised helpers over Arrow string columns (numpy only, used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space of every word definition here: blank and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(31))
    x = x * _A
    x = x ^ (x >> np.uint64(29))
    x = x * _B
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values end to end, and len + 1 offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 21, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one piece has at most ``rows`` rows, and texts of about ``limit`` bytes
    (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1))
            yield batch.slice(begin, end - begin)
            begin = end


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (len + 1)."""
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    begins = np.flatnonzero(start)
    return begins, np.flatnonzero(end) + 1, np.searchsorted(begins, at)


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, zeros behind the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1), writeable=False)


def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(lanes[at]).view(np.uint64).ravel() & _MASK[left]


def same_spans(raw: np.ndarray, begins: np.ndarray, size: np.ndarray, other: np.ndarray, other_begins: np.ndarray, other_size: np.ndarray) -> bool:
    """Whether every span of ``raw`` has the bytes of its span of ``other``.

    ``other`` has eight spare bytes behind its last span.
    """
    if not np.array_equal(size, other_size):
        return False
    a, b = _lanes(raw), np.lib.stride_tricks.as_strided(other, (len(other) - 7, 8), (1, 1), writeable=False)
    active, done = np.flatnonzero(size > 0), 0
    while len(active):
        left = np.minimum(size[active] - done, 8)
        if not np.array_equal(_lane(a, begins[active] + done, left), _lane(b, other_begins[active] + done, left)):
            return False
        done += 8
        active = active[size[active] > done]
    return True


def hash_spans(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    size = ends - begins
    lanes = _lanes(raw)
    out = mix(size.astype(np.uint64) + np.uint64(seed * 0x51ED27 + 1))
    active, done = np.flatnonzero(size > 0), 0
    while len(active):
        left = np.minimum(size[active] - done, 8)
        out[active] = mix(out[active] * _A ^ _lane(lanes, begins[active] + done, left))
        done += 8
        active = active[size[active] > done]
    return out
