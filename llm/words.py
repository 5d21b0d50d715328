"""Words, word hashes and shingle sets of whole Arrow columns, worked out on the raw UTF-8 bytes.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
None of these bytes occurs inside a multi-byte character, so byte positions are safe. All work is
vectorised over many documents; `slices` bounds how many bytes are in hand at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Odd multiplier and one random 64-bit value per byte: a polynomial hash modulo 2**64, mixed afterwards.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
SLICE_BYTES = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 (public domain), a bijection on 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; a longer text comes alone."""
    raw, offsets = _buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Words:
    """Words of a slice: byte `start` and `end`, and for each row the range `first[row]:first[row + 1]`.

    `between` marks the bytes that end words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE):
        inside = ~between[raw]
        begins = inside.copy()
        if len(raw):
            begins[1:] &= ~inside[:-1]
            edges = offsets[:-1][offsets[:-1] < len(raw)]
            begins[edges] = inside[edges]
        self.raw = raw
        self.between = between
        self.start = np.flatnonzero(begins)
        ends = inside.copy()
        if len(raw):
            ends[:-1] &= ~inside[1:]
            edges = offsets[1:][offsets[1:] > 0] - 1
            ends[edges] = inside[edges]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool = False, prefixes: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
        """A 64-bit hash of every word, ASCII letters lower-cased on request.

        With `prefixes`, a list: hashes of whole words, then of their first so many bytes."""
        if not len(self.start):
            none = np.zeros(0, np.uint64)
            return [none] * (1 + len(prefixes)) if prefixes else none
        size = self.end - self.start
        powers = np.empty(int(size.max()), np.uint64)
        powers[0] = 1
        powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, BASE))
        inside = ~self.between[self.raw]
        values = (BYTE_VALUES[LOWER] if lower else BYTE_VALUES)[self.raw[inside]]
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        place = np.arange(at[-1]) - np.repeat(at[:-1], size)
        values *= powers[place]
        out = [mix(np.add.reduceat(values, at[:-1]) + size.astype(np.uint64))]
        for n in prefixes:
            values[place >= n] = 0
            out.insert(1, mix(np.add.reduceat(values, at[:-1]) + np.uint64(n)))
        return out if prefixes else out[0]


def sequence_hash(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of `length` values; order matters. Rows are not told apart here."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(0x5851F42D4C957F2D + 2 * seed))
    for i in range(length):
        out = mix(out * BASE + hashes[i:i + n]) if i % 8 == 7 or i == length - 1 else out * BASE + hashes[i:i + n]
    return out
