"""The second consumer: valid transfers into a columnar fact table, independent of the resolver.

It has its own checkpoint. Each batch overwrites its own folder, nothing is shuffled on the way in,
and the table is read through a replacing merge on (to_account, ts, txn_id), so repeated copies
are seen once. With `within`, copies that come soon after the first are not even stored; this keeps state and is off by default.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casetrail.functions.dates import utc_now
from casetrail.operators.dedupe import drop_copies_within, latest_copy
from casetrail.operators.validate import validate
from casetrail.schemas import TRANSACTIONS

MERGE_KEY = ["to_account", "ts", "txn_id"]


def fact_rows(judged: DataFrame) -> DataFrame:
    """Exact decimals; time in milliseconds, as the columnar store keeps it."""
    rows = judged.filter("verdict <> 'rejected'").select("model.*")
    return rows.withColumn("ts", F.date_trunc("MILLISECOND", "ts"))


def run_facts(messages: DataFrame, path: str, checkpoint: str, now: datetime | None = None,
              trigger: dict | None = None, within: str | None = None, arrived: Column | None = None,
              partitions: int | None = None, **bounds) -> StreamingQuery:
    """Counts arrive as the observed metrics `inserted` and `skipped_invalid` of `facts`. `within`, `arrived`: see
    `drop_copies_within`; its state is dealt to `partitions` tasks (else the session's shuffle partitions), which the
    first start with a checkpoint fixes."""
    transfers = messages.filter(F.col("source") == "transactions")
    if within is not None:
        transfers = drop_copies_within(transfers, within, arrived)

    def step(batch_df: DataFrame, batch: int) -> None:
        judged = validate(batch_df, "transactions", now or utc_now(), **bounds)
        valid = F.count_if(F.col("verdict") != "rejected")
        counted = judged.observe("facts", valid.alias("inserted"),
                                 (F.count("*") - valid).alias("skipped_invalid"))
        query = batch_df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"
        (fact_rows(counted).sortWithinPartitions(*MERGE_KEY)
         .write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch}"))

    stream = transfers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True}))
    spark, dealt = messages.sparkSession, "spark.sql.shuffle.partitions"
    session = spark.conf.get(dealt)
    # A stream takes the settings with it when it starts.
    spark.conf.set(dealt, str(partitions or session))
    try:
        return stream.start()
    finally:
        spark.conf.set(dealt, session)


def read_facts(spark: SparkSession, path: str, merged: bool = True) -> DataFrame:
    raw = spark.read.schema(f"{TRANSACTIONS}, query string, batch bigint").parquet(path)
    rows = latest_copy(raw, MERGE_KEY, [F.col("query"), F.col("batch")]) if merged else raw
    return rows.drop("query", "batch")
