"""The data model's views over the given warehouse tables (customers, orders, events, ...).

Customers open accounts, suppliers are the sanctions list, orders are transfers, events are logins,
documents are case notes, conversations are transcripts of answered questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.functions.text import normalise_name, normalise_phone
from casetrail.session import spread, tune


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def padded(prefix: str, number: Column, digits: int) -> Column:
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0")))


def account_id(number: Column) -> Column:
    return padded("A", number, 6)


def _birth_date(key: Column) -> Column:
    return F.date_add(F.lit("1950-01-01").cast("date"), (key * 37 % 50).cast("int"))


def kyc(spark: SparkSession, folder: str) -> DataFrame:
    """Account openings with shared phones, e-mails, birth dates and names."""
    customer, part = table(spark, folder, "customer"), table(spark, folder, "part")
    parts = part.count()
    key = F.col("c_custkey")
    # Small files, and much work for each row: names, trigrams, JSON.
    named = spread(customer, "c_custkey").join(part, F.col("p_partkey") == key % parts)
    return named.select(
        padded("KYC-", key, 6).alias("record_id"), account_id(key).alias("account_id"),
        F.concat_ws(" ", "p_name", "c_mktsegment").alias("full_name"),
        _birth_date(F.floor(key / 2)).alias("date_of_birth"),
        F.concat(F.lit("0"), (600000000 + F.floor(key / 3)).cast("string")).alias("phone"),
        F.when(key % 5 == 0, F.concat(F.lit("u"), F.floor(key / 10).cast("string"), F.lit("@example.com")))
         .alias("email"),
        F.concat(F.lit("City"), (F.col("c_nationkey") % 5).cast("string")).alias("city"),
        (F.lit("2016-01-01").cast("timestamp") + F.make_dt_interval(hours=(key % 70000).cast("int")))
         .alias("opened_at"),
        key.alias("arrival"))


def prepared_kyc(spark: SparkSession, folder: str) -> DataFrame:
    return kyc(spark, folder).withColumns({
        "phone_e164": normalise_phone(F.col("phone")), "name_norm": normalise_name(F.col("full_name")),
        "email_key": F.lower("email")})


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts before resolution: every opening is its own person."""
    return prepared_kyc(spark, folder).select(
        "account_id", F.regexp_replace("account_id", "^A", "P-").alias("person_id"), "full_name", "name_norm",
        "phone_e164", "email", "city", "opened_at", F.col("record_id").alias("kyc_evidence_id"),
        F.lit("NEW").alias("matched_rule"))


def sanctions(spark: SparkSession, folder: str) -> DataFrame:
    supplier, part = table(spark, folder, "supplier"), table(spark, folder, "part")
    parts = part.count()
    key = F.col("s_suppkey")
    other = part.select(F.col("p_partkey").alias("_other"), F.col("p_name").alias("_alias"))
    listed = (spread(supplier, "s_suppkey").join(part, F.col("p_partkey") == key % parts)
              .join(other, F.col("_other") == (key * 7 + 1) % parts))
    return listed.select(
        padded("S-", key, 3).alias("entry_id"), F.concat(F.col("p_name"), F.lit(" BUILDING")).alias("full_name"),
        F.when(key % 3 != 0, _birth_date(key)).alias("date_of_birth"),
        F.concat(F.lit("LIST-"), F.col("s_nationkey").cast("string")).alias("list_name"),
        F.array(F.concat(F.lit("Mr "), F.col("_alias"), F.lit(" MACHINERY"))).alias("aliases"))


CHANNELS = {"1-URGENT": "app", "2-HIGH": "web", "3-MEDIUM": "ussd", "4-NOT SPECIFIED": "fax", "5-LOW": "card"}


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """All transfers as they were sent, with unknown channels and transfers to oneself."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer").count()
    key, payer = F.col("o_orderkey"), F.col("o_custkey")
    channel = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in CHANNELS.items()])
    return orders.select(
        padded("T", key, 7).alias("txn_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        account_id(payer).alias("from_account"),
        account_id((payer * 7 + key % 3) % customers).alias("to_account"),
        F.col("o_totalprice").alias("amount_zar"), channel.alias("channel"),
        F.concat_ws(" ", F.lit("order"), "o_orderstatus").alias("reference"), key.alias("arrival"))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The stored transfers: known channel, two different accounts, exact money."""
    sent = transfers(spark, folder)
    return (sent.filter("channel <> 'fax' and from_account <> to_account")
            .withColumn("amount_zar", F.col("amount_zar").cast("decimal(14,2)")))


def logins(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select(
        padded("L", F.col("event_id"), 7).alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        account_id(F.col("user_id")).alias("account_id"),
        F.concat(F.lit("D-"), F.lpad(F.lower(F.hex(F.floor(F.col("user_id") / 3))), 8, "0")).alias("device_id"),
        F.concat(F.lit("198.51.100."), (F.col("user_id") % 250).cast("string")).alias("ip"),
        (F.col("event_type") != "error").alias("success"), F.col("event_id").alias("arrival"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    documents, customers = table(spark, folder, "documents"), table(spark, folder, "customer").count()
    return documents.select(
        padded("N-", F.col("doc_id"), 5).alias("note_id"),
        account_id(F.col("doc_id") % customers).alias("account_id"), F.col("source").alias("author"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") % 500000).cast("int")))
         .alias("created_at"), "text")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as runs: the user's turns are tool results, the assistant's are answers."""
    talk = table(spark, folder, "conversations")
    return talk.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "assistant", "ai").otherwise("tool").alias("role"),
        F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", 1).otherwise(0).alias("tool_calls"),
        F.length("text").alias("input_tokens"), F.size(F.split("text", " ")).alias("output_tokens"))


def as_messages(df: DataFrame, source: str, id_field: str, value: Column | None = None) -> DataFrame:
    """Message envelopes of a view; `arrival` becomes the offset."""
    fields = [c for c in df.columns if c != "arrival"]
    body = F.to_json(F.struct(*fields)) if value is None else value
    return df.select(F.lit(source).alias("source"), F.lit(f"raw.{source}").alias("topic"),
                     F.lit(0).alias("partition"), F.col("arrival").alias("offset"),
                     F.col(id_field).alias("key"), body.alias("value"))
