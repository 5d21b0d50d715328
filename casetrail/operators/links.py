"""The link graph: events that support a link, and the fold to one row per (src, dst, kind).

A link event is (src, dst, kind, arrival, evidence array, ts, amount, score). Every part of the
fold is mergeable, so folding batches and then folding the results gives the same links.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions.ids import node
from casetrail.schemas import IDENTITY_KINDS, LINK_KINDS, MAX_EVIDENCE

KEY = ["src", "dst", "kind"]


def _event(df: DataFrame, src, dst, kind: str, evidence, ts, amount=None, score=None) -> DataFrame:
    return df.select(
        src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"),
        F.col("arrival").cast("bigint").alias("arrival"), evidence.alias("evidence"),
        ts.cast("timestamp").alias("ts"),
        (F.lit(None) if amount is None else amount).cast("decimal(14,2)").alias("amount"),
        (F.lit(None) if score is None else score).cast("double").alias("score"))


def owns_events(resolved: DataFrame) -> DataFrame:
    """person -> account, for every account opening (a repeated account id too)."""
    return _event(resolved, node("person", F.col("person_id")), node("account", F.col("account_id")),
                  "OWNS", F.array("record_id"), F.col("opened_at"))


def phone_events(kyc: DataFrame) -> DataFrame:
    return _event(kyc, node("account", F.col("account_id")), node("phone", F.col("phone_e164")),
                  "REGISTERED_PHONE", F.array("record_id"), F.col("opened_at"))


def login_events(logins: DataFrame) -> DataFrame:
    """account -> device; a failed attempt may be somebody else and makes no link."""
    return _event(logins.filter("success"), node("account", F.col("account_id")),
                  node("device", F.col("device_id")), "LOGGED_IN_FROM",
                  F.array("event_id"), F.col("ts"))


def transfer_events(txns: DataFrame) -> DataFrame:
    return _event(txns, node("account", F.col("from_account")), node("account", F.col("to_account")),
                  "SENT_TO", F.array("txn_id"), F.col("ts"), amount=F.col("amount_zar"))


def sanction_events(hits: DataFrame) -> DataFrame:
    """person -> sanctions entry; cites the account opening and the entry."""
    return _event(hits, node("person", F.col("person_id")), node("sanction", F.col("entry_id")),
                  "SANCTIONS_MATCH", F.array("record_id", "entry_id"), F.col("opened_at"),
                  score=F.col("score"))


def opening_folds(openings: DataFrame, tag: int = 0) -> DataFrame:
    """Account openings folded by person, name and birth date: what `sanction_folds` needs of all that a list entry matches alike."""
    spelling = ["src", "name_norm", "date_of_birth"]
    rows = openings.select(node("person", F.col("person_id")).alias("src"), "name_norm", "date_of_birth",
                           F.col("arrival").cast("bigint").alias("arrival"), "record_id",
                           F.col("opened_at").cast("timestamp").alias("ts")).filter("src IS NOT NULL AND name_norm IS NOT NULL")
    totals = rows.groupBy(*spelling).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    order = Window.partitionBy(*spelling).orderBy("arrival", "record_id")
    first = (rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= MAX_EVIDENCE)
             .groupBy(*spelling).agg(F.array_sort(F.collect_list(F.struct(
                 F.lit(tag).cast("bigint").alias("tag"), "arrival", "record_id"))).alias("first"))
             .select(*[F.col(c).alias(f"_{c}") for c in spelling], "first"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in spelling])
    several = totals.groupBy("src").agg((F.count("*") > 1).alias("several"))
    return totals.join(first, same).drop(*[f"_{c}" for c in spelling]).join(several, "src")


def sanction_folds(matched: DataFrame) -> DataFrame:
    """Partial rows of person -> sanctions entry, as `fold_events` of `sanction_events`, from rows of `opening_folds` with entry_id
    and score. Only persons known by several names or birth dates are folded again; the rows of the others do not move."""
    evidence = F.transform("first", lambda e: F.struct(
        e["tag"].alias("tag"), e["arrival"].alias("arrival"), F.array(e["record_id"], F.col("entry_id")).alias("evidence")))
    rows = matched.filter("entry_id IS NOT NULL").select(
        "src", node("sanction", F.col("entry_id")).alias("dst"), F.lit("SANCTIONS_MATCH").alias("kind"), F.col("n").alias("weight"),
        F.lit(None).cast("decimal(16,2)").alias("total_zar"), F.col("score").cast("double").alias("score"),
        "first_seen", "last_seen", evidence.alias("first_events"), "several")
    return rows.filter("NOT several").drop("several").unionByName(merge_folds(rows.filter("several").drop("several")))


def fold_events(events: DataFrame, tag: int = 0) -> DataFrame:
    """One partial row per link. `first_events` keeps what is needed to merge evidence later:
    at most the first 20 events (batch tag, arrival, ids)."""
    totals = events.groupBy(*KEY).agg(
        F.count("*").alias("weight"),
        F.sum("amount").cast("decimal(16,2)").alias("total_zar"),
        F.max("score").alias("score"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    order = Window.partitionBy(*KEY).orderBy("arrival", "evidence")
    first = (events.select(*KEY, "arrival", "evidence")
             .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= MAX_EVIDENCE)
             .groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(
                 F.lit(tag).cast("bigint").alias("tag"), "arrival", "evidence"))).alias("first_events")))
    return totals.join(first, KEY)


def merge_folds(folds: DataFrame) -> DataFrame:
    """Merge partial rows; a key has few of them (one or two a batch, one for each spelling of a person), so groups are short."""
    events = F.slice(F.array_sort(F.flatten(F.collect_list("first_events"))), 1, MAX_EVIDENCE)
    return folds.filter(" AND ".join(f"{c} IS NOT NULL" for c in KEY)).groupBy(*KEY).agg(
        F.sum("weight").alias("weight"),
        F.sum("total_zar").cast("decimal(16,2)").alias("total_zar"),
        F.max("score").alias("score"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.when(F.count("*") > 1, events).otherwise(F.first("first_events")).alias("first_events"))


def as_links(folds: DataFrame) -> DataFrame:
    """The public link table. Ids are appended while fewer than 20 are held."""
    ids = F.flatten(F.transform("first_events", lambda e: e["evidence"]))
    return folds.select(*KEY, F.col("weight").cast("bigint").alias("weight"), "total_zar", "score",
                        "first_seen", "last_seen",
                        F.slice(ids, 1, MAX_EVIDENCE).alias("evidence_ids"))


def fold_links(events: DataFrame) -> DataFrame:
    return as_links(fold_events(events))


def of_kinds(links: DataFrame, kinds: list[str] | None) -> DataFrame:
    if kinds is None:
        return links
    unknown = set(kinds) - set(LINK_KINDS)
    if unknown:
        raise ValueError(f"unknown link kinds: {sorted(unknown)}")
    return links.filter(F.col("kind").isin(*kinds))


def strongest_first() -> list:
    """Who somebody is before what they did, then weight, then money; ids settle ties."""
    return [F.col("kind").isin(*IDENTITY_KINDS).desc(), F.col("weight").desc(),
            F.col("total_zar").desc_nulls_last(), F.col("kind"), F.col("src"), F.col("dst")]
