"""A Bloom filter over a column of numbers, built in tasks by segments and broadcast.

BITS_PER_KEY bits a key, at most `largest` bytes, which bounds what the driver and tasks hold. Beyond that it
lets more through; it never misses a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.words import mix

BITS_PER_KEY, LARGEST, SEGMENTS = 8, 64 << 20, 64


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two positions for each 64-bit key."""
    h = mix(keys.astype(np.int64).view(np.uint64))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)], axis=1).astype(np.int64)


def holds(packed: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = places(keys, bits)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def _segments(bits: int):
    span = bits // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(batch.column(0).to_numpy(), bits))
            yield pa.record_batch([pa.array((at // span).astype(np.int32)), pa.array((at % span).astype(np.int32))],
                                  ["segment", "at"])
    return run


def _packed(bits: int):
    span = bits // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(segment).tolist():
                held.setdefault(k, np.zeros(span, bool))[at[segment == k]] = True
        for k, flags in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())],
                                  ["segment", "bits"])
    return run


def build(keys: DataFrame, count: int, largest: int = LARGEST) -> tuple[bytes, int]:
    """The packed filter and its size in bits, of the one column of `keys` (long, no nulls)."""
    bits = min(8 * largest, max(4096, 1 << (BITS_PER_KEY * max(count, 1) - 1).bit_length()))
    parts = keys.mapInArrow(_segments(bits), "segment int, at int").repartition(SEGMENTS, "segment").mapInArrow(
        _packed(bits), "segment int, bits binary")
    span, out = bits // SEGMENTS // 8, bytearray(bits // 8)
    for row in parts.collect():  # at most `largest` bytes
        out[row["segment"] * span:(row["segment"] + 1) * span] = row["bits"]
    return bytes(out), bits
