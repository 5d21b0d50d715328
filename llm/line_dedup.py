"""Repeated lines removed, found with two Bloom filters.

First pass: each task notes which filter bits its documents' lines set, split by filter segment; the
segments are merged into bits seen once and bits seen in two documents or more. Only the second filter
is used: it never misses a repeat. Second pass: lines whose bits are all in it are suspects, and
only suspects shuffle, as 128-bit fingerprints, for exact counts and the choice of the first document.
Third pass: each document drops the lines of its confirmed fingerprints.

The filter has BITS_PER_LINE bits a line and at most LARGEST_FILTER bytes, which bounds the broadcast;
beyond that it only lets more suspects through, the result stays exact and complete.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys under
`shortest` code points never count. Null and empty texts are one empty line. Rows without
doc_id keep all their lines and don't count as documents; rows of one doc_id are one document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import written

SHORTEST = 10
BITS_PER_LINE = 8
LARGEST_FILTER = 64 << 20
SEGMENTS = 64
WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Raw lines and their keys."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip(WHITE).lower() for x in lines]


def long_enough(key: bytes, shortest: int) -> bool:
    size = len(key)
    return size >= shortest and (size >= 4 * shortest or len(key.decode("utf-8", "surrogatepass")) >= shortest)


def prints(text: str | None, shortest: int) -> set[bytes]:
    """Fingerprints of the distinct keys of one text."""
    _, keys = line_keys(text)
    return {xxhash.xxh3_128_digest(k) for k in set(keys) if long_enough(k, shortest)}


def places(found: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions for each 16-byte fingerprint."""
    pair = found.view(np.uint64).reshape(-1, 2)
    return (pair & np.uint64(bits - 1)).astype(np.int64)


def _as_array(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.uint8)


def _marks(shortest: int, bits: int):
    """Bits that the documents of a task set: (segment, one: set by any line, two: set by two lines or more)."""
    span = bits // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = []
        for batch in batches:
            for text, doc in zip(batch.column(0), batch.column(1), strict=True):
                if doc.as_py() is not None and (found := prints(text.as_py(), shortest)):
                    each.append(np.unique(places(_as_array(list(found)), bits)))
        if not each:
            return
        one, times = np.unique(np.concatenate(each), return_counts=True)
        two = one[times > 1]
        for k in np.unique(one // span).tolist():
            parts = [_packed(x[np.searchsorted(x, k * span):np.searchsorted(x, (k + 1) * span)] - k * span, span)
                     for x in (one, two)]
            yield pa.record_batch([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)],
                                  ["segment", "one", "two"])
    return run


def _packed(at: np.ndarray, span: int) -> bytes:
    """A bitmap, as compressed differences of its set positions while few are set."""
    if len(at) > span // 24:
        flags = np.zeros(span, bool)
        flags[at] = True
        return zstandard.compress(b"d" + np.packbits(flags).tobytes(), 1)
    gaps = np.diff(at, prepend=0)
    return zstandard.compress(b"s" + gaps.astype(np.uint8).tobytes() + (gaps >> 8).astype(np.uint8).tobytes()
                              + (gaps >> 16).astype(np.uint16).tobytes(), 1)


def _unpacked(data: bytes, span: int) -> np.ndarray:
    raw = zstandard.decompress(data)
    if raw[:1] == b"d":
        return np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=span).astype(bool)
    n = (len(raw) - 1) // 4
    body = np.frombuffer(raw, np.uint8, offset=1)
    gaps = body[:n].astype(np.int64) | body[n:2 * n].astype(np.int64) << 8
    gaps |= np.frombuffer(body[2 * n:].tobytes(), np.uint16).astype(np.int64) << 16
    flags = np.zeros(span, bool)
    flags[np.cumsum(gaps)] = True
    return flags


def _merge(bits: int):
    """Bits set in two documents or more, for each segment, from the marks of all tasks, one after another."""
    span = bits // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = held.setdefault(k, (np.zeros(span, bool), np.zeros(span, bool)))
                new = _unpacked(one, span)
                twice |= _unpacked(two, span) | (once & new)
                once |= new
        for k, (_, twice) in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())],
                                  ["segment", "twice"])
    return run


def filter_bits(lines: int, largest: int = LARGEST_FILTER) -> int:
    """A power of two, from 4096 bits to 8 * largest."""
    return min(8 * largest, max(4096, 1 << (BITS_PER_LINE * max(lines, 1) - 1).bit_length()))


def seen_twice(docs: DataFrame, shortest: int = SHORTEST, largest: int = LARGEST_FILTER) -> tuple[bytes, int]:
    """The packed filter of lines seen in two documents or more, and its size in bits."""
    counted = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0]
    bits = filter_bits(counted or 0, largest)
    marks = docs.select("text", "doc_id").mapInArrow(_marks(shortest, bits), "segment int, one binary, two binary")
    merged = marks.repartition(SEGMENTS, "segment").mapInArrow(_merge(bits), "segment int, twice binary")
    span, packed = bits // SEGMENTS // 8, bytearray(bits // 8)
    for row in merged.collect():  # at most `largest` bytes
        packed[row["segment"] * span:(row["segment"] + 1) * span] = row["twice"]
    return bytes(packed), bits


def _suspects(twice, bits: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            found, owner = [], []
            for text, doc in zip(batch.column(0), batch.column(1), strict=True):
                if (number := doc.as_py()) is not None:
                    mine = prints(text.as_py(), shortest)
                    found += mine
                    owner += [number] * len(mine)
            if not found:
                continue
            raw = _as_array(found)
            at = places(raw, bits)
            hit = (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)
            pair = raw.view(np.int64).reshape(-1, 2)[hit]
            yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1]),
                                   pa.array(np.array(owner, np.int64)[hit])], ["high", "low", "doc_id"])
    return run


def repeated_lines(docs: DataFrame, shortest: int = SHORTEST, largest: int = LARGEST_FILTER) -> DataFrame:
    """high, low, doc_id: fingerprints that a document must drop."""
    packed, bits = seen_twice(docs, shortest, largest)
    twice = docs.sparkSession.sparkContext.broadcast(packed)
    suspects = written(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        _suspects(twice, bits, shortest), "high long, low long, doc_id long"), "suspects")
    confirmed = written(suspects.groupBy("high", "low").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
        .select("high", "low", "first"), "repeated")
    return suspects.join(confirmed, ["high", "low"]).filter("doc_id > first").select("high", "low", "doc_id")


def _drop(shortest: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
                text, gone = text.as_py(), gone.as_py()
                lines, keys = line_keys(text)
                left = lines
                if gone:
                    gone = {struct.pack("<qq", g["high"], g["low"]) for g in gone}
                    left = [x for x, k in zip(lines, keys, strict=True)
                            if not (long_enough(k, shortest) and xxhash.xxh3_128_digest(k) in gone)]
                total.append(len(lines))
                dropped.append(len(lines) - len(left))
                data = b"\n".join(left)
                kept.append(hashlib.sha256(data).hexdigest() if digest else data.decode("utf-8", "surrogatepass"))
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("text", "gone")]
            names = [n for n in batch.schema.names if n not in ("text", "gone")]
            yield pa.record_batch([*rest, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()),
                                   pa.array(kept, pa.string())], [*names, "n_lines", "n_dropped", "kept"])
    return run


def drop_repeated_lines(docs: DataFrame, shortest: int = SHORTEST, largest: int = LARGEST_FILTER,
                        digest: bool = False, carry: list[str] = ()) -> DataFrame:
    """doc_id, the columns of `carry`, n_lines, n_dropped and kept: the remaining text or its SHA-256.

    Lines with a key that two documents hold stay only in the smallest doc_id that holds it.
    """
    gone = repeated_lines(docs, shortest, largest)
    lists = gone.groupBy("doc_id").agg(F.collect_list(F.struct("high", "low")).alias("gone"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.join(lists, "doc_id", "left").mapInArrow(
        _drop(shortest, digest), f"{kinds}, n_lines long, n_dropped long, kept string")
