"""Counts of 64-bit tokens in a table of fixed size (one row of a count-min sketch), made in tasks by segments.

A cell holds at least the count of any token that falls into it. The table's size never depends on the
data, so it can be broadcast; tasks send the cells they touched, compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import written

CELLS, SEGMENTS = 1 << 22, 64
SPAN = CELLS // SEGMENTS


def cell(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(13)) & np.uint64(CELLS - 1)).astype(np.int64)


def _partial(tokens_of: Callable[[pa.RecordBatch], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.uint32)
        for batch in batches:
            at, n = np.unique(cell(tokens_of(batch)), return_counts=True)
            table[at] += n.astype(np.uint32)
        for k in range(SEGMENTS):
            part = table[k * SPAN:(k + 1) * SPAN]
            at = np.flatnonzero(part)
            if len(at):
                data = np.concatenate([np.diff(at, prepend=0).astype(np.uint32), part[at]])
                by_byte = data.view(np.uint8).reshape(-1, 4).T.tobytes()  # like bytes together compress better
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zstandard.compress(by_byte, 3)], pa.binary())],
                                      ["segment", "data"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
            gaps, n = raw[:len(raw) // 2], raw[len(raw) // 2:]
            part = held.setdefault(k, np.zeros(SPAN, np.uint64))
            part[np.cumsum(gaps.astype(np.int64))] += n
    for k, part in held.items():
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["segment", "data"])


def _merged(df: DataFrame, tokens_of: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    return df.mapInArrow(_partial(tokens_of), "segment int, data binary").repartition(SEGMENTS, "segment").mapInArrow(
        _merge, "segment int, data binary")


def counts(df: DataFrame, tokens_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """CELLS counts of the tokens that tokens_of gives for the batches of df."""
    out = np.zeros(CELLS, np.uint64)
    for row in _merged(df, tokens_of).collect():  # 8 bytes a cell
        out[row["segment"] * SPAN:(row["segment"] + 1) * SPAN] = np.frombuffer(row["data"], np.uint64)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = sum(int(np.frombuffer(data, np.uint64).sum()) for data in batch.column("data").to_pylist())
        yield pa.record_batch([pa.array([total], pa.int64())], ["total"])


def _above(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column("segment").to_pylist(), batch.column("data").to_pylist(), strict=True):
                part = np.frombuffer(data, np.uint64)
                at = np.flatnonzero(part >= least)
                yield pa.record_batch([pa.array((at + k * SPAN).astype(np.int64)), pa.array(
                    np.minimum(part[at], 2 ** 32 - 1).astype(np.int64))], ["cell", "n"])
    return run


def common_cells(df: DataFrame, tokens_of: Callable[[pa.RecordBatch], np.ndarray], times: int,
                 extra: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells, sorted, of at least `times` the mean count and `extra`, and their counts.

    Only these come to the driver: fewer than CELLS / times.
    """
    table = written(_merged(df, tokens_of), "sketch")
    total = table.select("data").mapInArrow(_sums, "total long").agg(F.sum("total")).first()[0] or 0
    found = table.mapInArrow(_above(times * total / CELLS + extra), "cell long, n long").toArrow()
    cells, n = (found.column(c).to_numpy() for c in ("cell", "n"))
    order = np.argsort(cells)
    return cells[order], n[order].astype(np.uint32)
