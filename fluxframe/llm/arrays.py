"""Vectorised text primitives on Arrow buffers: slices, words and their hashes, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        if n > 1 << 22:  # of an unusually long text; not worth keeping
            return out[:n]
        have = _powers[base] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class RangeHash:
    """Hashes of any ranges of one sequence, from prefix sums of value * base ** place."""

    def __init__(self, values: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(values) + 1, U64)
            np.cumsum((values.astype(U64) + U64(1)) * _power(_BASE, len(values)), out=self.sums[1:])
        self.shift = _power(_INVERSE, len(values) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.shift[start]
            return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def release() -> None:
    """Gives freed memory back to the system: workers stay alive between tasks of different operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about limit bytes of the text column: a row that is longer comes alone."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
                yield batch.slice(lo, hi - lo)
                lo = hi
    finally:
        batch = None
        for base in [b for b, have in _powers.items() if len(have) > 1 << 20]:
            del _powers[base]
        release()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and each row's offsets in them; null counts as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The bytes of ascending ranges that don't overlap, as one binary column."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1  # a range isn't empty, so no two start or end at one place
    edge[end] -= 1
    inside = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.append(0, np.cumsum(end - start)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(inside))])


def words(data: np.ndarray, offsets: np.ndarray, ink: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are ink (by byte; else all but white space), row by row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ink[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return start, end, np.searchsorted(offsets, start, side="right") - 1
