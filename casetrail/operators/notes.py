"""Analyst notes: turn text into vectors, fill in missing vectors, find the nearest notes.

An embedder is any function (texts, kind) -> list of vectors, kind being "document" or "query".
Without one, words and 4-grams are hashed, which matches shared words, not meaning. Vectors are kept
with six decimals.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from casetrail.functions.vectors import DIM, features
from casetrail.session import spread

Embedder = Callable[[list[str], str], list[list[float]]]
MAX_K = 20
QUERY_BLOCK, VECTOR_BLOCK = 64, 16384
TEXTS_AT_ONCE = 64


@lru_cache(maxsize=1 << 20)
def _place(feature: str, dim: int) -> tuple[int, int]:
    """Bucket and sign of a feature: its MD5 number modulo dim, and bit 64 of the number."""
    number = int.from_bytes(hashlib.md5(feature.encode()).digest(), "big")
    return number % dim, 1 if number >> 64 & 1 else -1


def _counts(rows: pa.Array, dim: int) -> np.ndarray:
    """Signed counts of the features of each row (a list array)."""
    rows = rows.cast(pa.large_list(pa.large_string()))
    coded = rows.flatten().dictionary_encode()
    places = np.array([_place(f, dim) for f in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2)
    which = np.asarray(coded.indices, np.int64)
    row = np.repeat(np.arange(len(rows)), np.asarray(rows.value_lengths().fill_null(0), np.int64))
    return np.bincount(row * dim + places[which, 0], places[which, 1].astype(np.float64), len(rows) * dim).reshape(len(rows), dim)


def _hashed(rows: pa.Array, dim: int) -> np.ndarray:
    """The counts scaled to length 1; rows without features are zero."""
    counts = _counts(rows, dim)
    norms = np.sqrt((counts * counts).sum(axis=1))[:, None]
    return counts / np.where(norms > 0, norms, 1.0)


def hashed_vectors(df: DataFrame, text: str, dim: int = DIM) -> DataFrame:
    """df with `embedding` by the built-in embedder. Spark cuts texts into words and 4-grams; a task hashes each distinct
    one once and adds up."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                rows = np.round(_hashed(part.column(len(names)), dim), 6).astype(np.float32)
                ends = pa.array(np.arange(0, rows.size + 1, dim), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))],
                                                 [*names, "embedding"])

    cut_up = df.withColumn("_features", features(F.coalesce(F.col(text), F.lit(""))))
    return cut_up.mapInArrow(run, StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def embed(notes: DataFrame, embedder: Embedder | None = None, text: str = "text", batch: int = 32,
          partitions: int | None = None) -> DataFrame:
    """Adds `embedding`; a given embedder is called with `batch` texts at a time, else words are hashed.

    `partitions` deals the texts out first, for inputs of few files.
    """
    dealt = notes.repartition(partitions) if partitions else notes
    if embedder is None:
        return hashed_vectors(dealt, text)

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows: list = []
            for start in range(0, len(part), batch):
                rows += embedder(part.iloc[start:start + batch].tolist(), "document")
            yield pd.Series([np.round(np.asarray(v, dtype=np.float64), 6).astype(np.float32) for v in rows])

    # Marked so that no filter on the result makes the optimizer compute it a second time.
    return dealt.withColumn("embedding", vectors.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))


def pending(notes: DataFrame, embedded: DataFrame) -> DataFrame:
    """Notes that have no vector yet."""
    return notes.join(embedded.select("note_id"), "note_id", "left_anti")


def embed_pending(notes: DataFrame, embedded: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(note_id, embedding) to append to the vector table."""
    return embed(pending(notes, embedded), embedder).select("note_id", "embedding")


def sparse_hash(notes: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """The unscaled hashed vector as (key, bucket, value) rows. Spark cuts texts into words and 4-grams; a task hashes each
    distinct one once and adds up, and rows of one key are summed.

    Texts are dealt out by key, so the many features of a text are summed up where they arise.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                counts = _counts(part.column(1), dim)
                row, bucket = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(bucket), pa.array(counts[row, bucket].astype(np.int64))],
                    [key, "bucket", "value"])

    rows = spread(notes.select(key, text), key).select(key, features(F.col(text)).alias("_features"))
    summed = rows.mapInArrow(run, StructType([notes.schema[key], StructField("bucket", LongType()), StructField("value", LongType())]))
    return summed.groupBy(key, "bucket").agg(F.sum("value").alias("value")).filter("value <> 0")


def closest(batch: pa.RecordBatch, asked: list[tuple[str, np.ndarray]], k: int) -> tuple[list, list, list]:
    """(queries, keys, distances) of a batch's k closest rows, ties at the k-th included."""
    batch = batch.filter(batch.column(1).is_valid())
    found: tuple[list, list, list] = ([], [], [])
    if batch.num_rows == 0:
        return found
    rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    norms = np.sqrt((rows * rows).sum(axis=1))
    for name, query in asked:
        with np.errstate(invalid="ignore", divide="ignore"):
            away = 1 - (rows * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))
        away = np.round(away, 9) + 0.0   # no negative zero
        limit = np.partition(away, k - 1)[k - 1] if len(away) > k else np.inf
        chosen = np.flatnonzero((away <= limit) | np.isnan(away))
        found[0].extend([name] * len(chosen))
        found[1].extend(batch.column(0).take(pa.array(chosen)).to_pylist())
        found[2].extend(away[chosen].tolist())
    return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, embedding: str = "embedding") -> DataFrame:
    """(query, key, distance, rank): the k rows closest by cosine distance to each query, exactly.

    `queries` has `query` (string) and `vector`, any number of rows: they are dealt into blocks of
    QUERY_BLOCK, the vectors into blocks of VECTOR_BLOCK, and a task compares one block of either. Each pair of
    blocks hands on only its own k best. Ties go to the smaller key.
    """
    if not 1 <= k:
        raise ValueError("k must be positive")
    kind = vectors.schema[key].dataType.simpleString()
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    v_blocks = max(1, -(-vectors.count() // VECTOR_BLOCK))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    asked = queries.select("query", "vector", F.pmod(F.xxhash64("query"), F.lit(q_blocks)).alias("q"))
    asked = asked.select("*", every(v_blocks).alias("v"))
    rows = vectors.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("row"),
                          F.pmod(F.xxhash64(key), F.lit(v_blocks)).alias("rv"))
    rows = rows.select("*", every(q_blocks).alias("rq"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        named = [(r["query"], np.asarray(r["vector"], dtype=np.float64)) for r in left.to_pylist()]
        found: tuple[list, list, list] = ([], [], [])
        for batch in right.select(["key", "row"]).to_batches():
            for have, more in zip(found, closest(batch, named, k)):
                have.extend(more)
        return pa.table({"query": pa.array(found[0], pa.string()), key: pa.array(found[1], right.schema.field("key").type),
                         "distance": pa.array(found[2], pa.float64())})

    near = asked.groupBy("q", "v").cogroup(rows.groupBy("rq", "rv")).applyInArrow(
        compare, f"query string, {key} {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def search_notes(notes: DataFrame, text: str, k: int = 5, account_id: str | None = None,
                 embedder: Embedder | None = None) -> DataFrame:
    """The k notes closest to a question; lower distance is closer."""
    if not 3 <= len(text) <= 500:
        raise ValueError("a note question has 3 to 500 characters")
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    if account_id is not None and not re.fullmatch(r"A\d{6,}", account_id):
        raise ValueError("not an account number: A and six digits or more")
    some = notes if account_id is None else notes.filter(F.col("account_id") == account_id)
    spark = notes.sparkSession
    if embedder is None:
        one = spark.createDataFrame([(text,)], "query string")
        asked = hashed_vectors(one, "query").withColumnRenamed("embedding", "vector")
    else:
        question = np.round(np.asarray(embedder([text], "query")[0], dtype=np.float64), 6).astype(np.float32)
        asked = spark.createDataFrame([(text, question.tolist())], "query string, vector array<float>")
    near = nearest(some, asked, k, "note_id")
    return near.join(some, "note_id").select(
        "note_id", "account_id", "created_at", "text", F.round("distance", 4).alias("distance"), "rank")
