"""A learned rank index: from the number of a boundary in a text to its byte, by straight lines and residuals.

Boundaries are numbered from 0; the byte at which each begins grows with its number almost along
a straight line. Segments are fitted greedily: a segment goes on as long as one slope keeps all its boundaries
within ERROR bytes (the cone of allowed slopes has not closed; O'Rourke 1981, Ferragina and Vinciguerra, VLDB
2020). What the line misses is stored as one signed byte per boundary, so a predicted place is corrected exactly.
An index costs about a byte per boundary where a table of places would cost eight.
"""

from __future__ import annotations

import numpy as np

# The residual of a rounded prediction has to fit into a signed byte.
ERROR = 126
PIECE = 1 << 20


def _segment_end(at: np.ndarray, begin: int, error: int) -> tuple[int, float]:
    """First boundary that the segment beginning at `begin` cannot hold, and the segment's slope."""
    low, high, end, width = -np.inf, np.inf, begin + 1, 64
    while end < len(at):
        run = np.arange(end, min(end + width, len(at)))
        far = (run - begin).astype(np.float64)
        rise = (at[run] - at[begin]).astype(np.float64)
        lows = np.maximum(np.maximum.accumulate((rise - error) / far), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / far), high)
        closed = lows > highs
        if closed.any():
            stop = int(np.argmax(closed))
            if stop:
                low, high = lows[stop - 1], highs[stop - 1]
            end += stop
            break
        low, high, end, width = lows[-1], highs[-1], int(run[-1]) + 1, width * 2
    return end, 0.0 if end == begin + 1 else (low + high) / 2


class RankIndex:
    """Places of boundaries, fitted piece by piece so that only one piece is ever held as whole numbers."""

    def __init__(self, error: int = ERROR):
        self.error = error
        self.begin: list[int] = []
        self.place: list[int] = []
        self.slope: list[float] = []
        self.residuals: list[np.ndarray] = []
        self.size = 0

    def add(self, at: np.ndarray) -> None:
        """The next boundaries' places, in growing order."""
        done = 0
        while done < len(at):
            end, slope = _segment_end(at, done, self.error)
            run = np.arange(end - done)
            missed = at[done:end] - at[done] - np.floor(slope * run).astype(np.int64)
            self.begin.append(self.size + done)
            self.place.append(int(at[done]))
            self.slope.append(slope)
            self.residuals.append(missed.astype(np.int8))
            done = end
        self.size += len(at)

    def finish(self) -> RankIndex:
        self.begins = np.array(self.begin, np.int64)
        self.places = np.array(self.place, np.int64)
        self.slopes = np.array(self.slope)
        self.residual = np.concatenate(self.residuals) if self.residuals else np.zeros(0, np.int8)
        self.residuals = []
        return self

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Exact places of the boundaries with these numbers."""
        segment = np.searchsorted(self.begins, ranks, side="right") - 1
        line = np.floor(self.slopes[segment] * (ranks - self.begins[segment])).astype(np.int64)
        return self.places[segment] + line + self.residual[ranks]


def code_points(raw: np.ndarray, error: int = ERROR, piece: int = PIECE) -> RankIndex:
    """The index of all places in UTF-8 bytes at which a code point begins, and of the end as last boundary."""
    index = RankIndex(error)
    for begin in range(0, len(raw), piece):
        part = raw[begin:begin + piece]
        index.add(np.flatnonzero((part & 0xC0) != 0x80).astype(np.int64) + begin)
    index.add(np.array([len(raw)], np.int64))
    return index.finish()
