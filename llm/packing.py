"""Documents packed into token sequences by first-fit decreasing with a tournament tree.

A document's ids (with its closing id 0) are cut into full pieces of `length` ids, which are sequences
of their own, and one rest. Rests are dealt into randomised groups of about GROUP documents; in each
group they are placed, longest first, into the first sequence with room, found by descending a
tournament tree of the room left. Groups are independent tasks of bounded size; nothing is dropped.

Only places, lengths and checksums move; token ids stay in the task that made them, unless asked for.
A sequence is padded to `length`, except at a power of two, where none is needed. Null and empty texts
are the closing id alone. Repeated rows are packed as documents of their own.

With `order`, a column of dense places from 0, groups are runs of GROUP documents in that order, and a group's sequences
are numbered by the first document in them: sequences follow the order, to within a group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import written

LENGTH = 1024
GROUP = 4096
CLOSING = 0
MARK = "<|endoftext|>"
LONG_BLANK = 100_000


def encoder(json_path: str, ranks_path: str):
    """text -> ids as the tokenizer of json_path gives them, without special tokens added.

    ranks_path holds the same vocabulary for the faster library. A text with the special token's own
    string goes to the first library, whose way of reading it is the one that counts. So does a text with a run
    of LONG_BLANK white-space characters: the faster one's pattern matcher overflows on a run of about a million.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []
    blanks = re.compile(rf"\s{{{LONG_BLANK}}}")

    def encode(text: str) -> list[int]:
        if MARK not in text and not (len(text) >= LONG_BLANK and blanks.search(text)):
            return fast.encode_ordinary(text)
        if not exact:
            exact.append(Tokenizer.from_file(json_path))
        return exact[0].encode(text, add_special_tokens=False).ids
    return encode


def _token_pieces(json_path: str, ranks_path: str, length: int, order: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for batch in batches:
            tokens, sums = [], []
            for text in batch.column("text"):
                ids = np.array([*encode(text.as_py() or ""), CLOSING], dtype="<u4")
                tokens.append(len(ids))
                sums.append([zlib.crc32(ids[i:i + length].tobytes()) for i in range(0, len(ids), length)])
            place = {} if order is None else {"row": batch.column(order)}
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "doc_tokens": pa.array(tokens, pa.int64()),
                                   "sums": pa.array(sums, pa.list_(pa.int64())), **place})
    return run


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size. The tree's inner nodes hold the most room of any bin below them."""
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [length] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        need, node = int(sizes[k]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[k], offsets[k] = node - leaves, length - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def _pack(length: int, ordered: bool = False):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_tokens", "doc_id", "row"], kind="stable")
        tokens = group["doc_tokens"].to_numpy(np.int64)
        full, rest = tokens // length, tokens % length
        has = np.flatnonzero(rest)
        bins, offsets = first_fit_decreasing(rest[has], length)
        used = int(bins.max()) + 1 if len(bins) else 0
        pieces = full + (rest > 0)
        of = np.repeat(np.arange(len(group)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = nth < full[of]
        number = np.empty(len(of), np.int64)
        number[whole] = used + np.arange(int(whole.sum()))
        where, at = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        where[has], at[has] = bins, offsets
        number[~whole] = where[of[~whole]]
        if ordered and len(of):
            first = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, number, group["row"].to_numpy(np.int64)[of])
            number = np.argsort(np.argsort(first, kind="stable"), kind="stable")[number]
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(group["doc_id"].to_numpy(np.int64)[of], group["no_id"].to_numpy(bool)[of]),
            "start": nth * length,
            "length": np.where(whole, length, rest[of]),
            "ids_crc32": np.array([x for s in group["sums"] for x in s], np.int64),
            "doc_tokens": tokens[of], "sequence_id": (np.int64(group["group"].iloc[0]) << 32) + number,
            "offset": np.where(whole, 0, at[of])})
    return run


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


def pack(docs: DataFrame, json_path: str, ranks_path: str, length: int = LENGTH, group: int = GROUP,
         order: str | None = None) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([order] if order else []))
    counted = rows.mapInArrow(_token_pieces(json_path, ranks_path, length, order),
                              "doc_id long, doc_tokens long, sums array<long>" + (", row long" if order else ""))
    counted = written(counted if order else counted.withColumn("row", F.monotonically_increasing_id()), "tokens")
    groups = max(1, -(-counted.count() // group))
    mine = F.floor(F.col("row") / group) if order else F.pmod(F.xxhash64("row"), F.lit(groups))
    # pandas would turn ids with nulls among them into floats.
    dealt = counted.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
                           "doc_tokens", "sums", "row", mine.alias("group"))
    return dealt.groupBy("group").applyInPandas(_pack(length, order is not None), PIECES)
