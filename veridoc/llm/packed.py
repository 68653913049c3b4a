"""Words of UTF-8 bytes as numbers: cut, packed by length, radix-sorted and run-counted in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at a time.
SLICE = 4 << 20
#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: By number of bytes from 0 to 8: the bits of a big-endian word that they fill.
_FILLED = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)


def table_of(letters: bytes) -> np.ndarray:
    """True for the bytes named."""
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each row's begin; null is an empty row."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)), bounds - bounds[0]


def slices(data: np.ndarray, bounds: np.ndarray, between: np.ndarray, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """Whole rows of about ``size`` bytes together, as (first row, row after, bytes, part); a longer row comes in parts that
    end at a byte of the table ``between``. The bytes start where the first row or the part does."""
    size = size or SLICE
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        at, end = int(bounds[i]), int(bounds[j])
        if end - at <= size:
            yield i, j, data[at:end], False
        while end - at > size:  # one long row
            stop = at + size
            while stop < end and not between[data[stop : stop + 4096]].any():
                stop += 4096
            stop = min(end, stop + int(np.argmax(between[data[stop : stop + 4096]]))) if stop < end else end
            yield i, j, data[at:stop], True
            at = stop
            if end - at <= size:
                yield i, j, data[at:end], True
        i = j


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each unbroken run of True; a run does not go over the start of a row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(inside) + 1, bool)
    first[bounds] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int) -> list[np.ndarray]:
    """``n`` big-endian uint64 words of each term, filled up with zeros; their order is that of the bytes."""
    held = np.concatenate([data, np.zeros(8 * n, np.uint8)])
    windows = np.ndarray((len(data) + 8 * (n - 1) + 1,), ">u8", held, strides=(1,))
    return [windows[starts + 8 * k].astype(np.uint64) & _FILLED[np.clip(sizes - 8 * k, 0, 8)] for k in range(n)]


def radix_order(columns: list[np.ndarray], order: np.ndarray | None = None) -> np.ndarray:
    """The stable order of rows by their columns of uint64, by counting digits of 16 bits from the last to the first.
    Digits that are alike in all rows are passed over."""
    order = np.arange(len(columns[0])) if order is None else order
    for c in reversed(columns):
        for k in range(4):
            digit = (c >> np.uint64(16 * k)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """True where a sorted row differs from the one before it, and for the first."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the words of each row."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h ^= c
        for shift, odd in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(odd)
        h ^= h >> np.uint64(32)
    return h
