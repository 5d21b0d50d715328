"""The first arrival and the last copy per key. Keys applied before are in `sources.ledger`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_arrival(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key. The rank limit drops later copies before the shuffle already."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_copy(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Replacing-merge read: the last copy of every key."""
    return first_arrival(df, keys, [c.desc() for c in order])


def raw_and_merged_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows against rows left after merging copies."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_copies"))
    return per_key.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_stored"),
                       F.count("*").alias("rows_distinct"))


def drop_copies_within(messages: DataFrame, bound: str, arrived: Column | None = None) -> DataFrame:
    """A stream without exact copies of a message that come within `bound` ("2 hours") of the first one.

    Same source, key and value make a copy, so a damaged first delivery never hides a good second one. The state
    store holds a digest per message until the watermark of `arrived` has passed its bound; later copies go through, for
    the ledger or the replacing merge to find. `arrived` is when the message reached the topic; one that
    lags behind the newest by more than `bound` would be dropped as late, so an event's own time must not be
    used, nor a time before 1970-01-01 00:00:01. Without `arrived` it is the micro-batch's time, which never lags. Messages are shuffled once.
    """
    at = F.current_timestamp() if arrived is None else arrived
    marked = messages.withColumns({"_at": at, "_digest": F.sha2("value", 256)}).withWatermark("_at", bound)
    return marked.dropDuplicatesWithinWatermark(["source", "key", "_digest"]).drop("_at", "_digest")
