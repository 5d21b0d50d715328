"""Links and money summaries over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from casetrail.operators import links, summary
from casetrail.plans.registry import question
from casetrail.sources import tables

NOW = datetime(2001, 6, 1)
DAYS = 3650
LINK_COLUMNS = ["src", "dst", "kind", "weight"]


def link_events(spark, folder):
    return (links.transfer_events(tables.transactions(spark, folder))
            .unionByName(links.login_events(tables.logins(spark, folder)))
            .unionByName(links.phone_events(tables.prepared_kyc(spark, folder))))


def all_links(spark, folder):
    return links.fold_links(link_events(spark, folder))


def link_rows(folded):
    return folded.select(
        *LINK_COLUMNS, F.col("total_zar").cast("double").alias("total_zar"),
        F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
        F.array_join("evidence_ids", ",").alias("evidence"))


def link_sql(kind: str) -> str:
    return f"""
SELECT src, dst, kind, weight, CAST(total_zar AS DOUBLE) AS total_zar,
       strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen,
       array_to_string(evidence_ids, ',') AS evidence FROM links WHERE {kind}"""


@question(link_sql("kind = 'SENT_TO'"))
def links_sent_to(spark, folder):
    return link_rows(links.fold_links(links.transfer_events(tables.transactions(spark, folder))))


@question(link_sql("kind = 'LOGGED_IN_FROM'"))
def links_logged_in_from(spark, folder):
    return link_rows(links.fold_links(links.login_events(tables.logins(spark, folder))))


@question("""
SELECT 'person:P-' || substr(account_id, 2) AS src, 'account:' || account_id AS dst, 'OWNS' AS kind,
       1::BIGINT AS weight, NULL::DOUBLE AS total_zar, strftime(opened_at, '%Y-%m-%d %H:%M:%S') AS first_seen,
       strftime(opened_at, '%Y-%m-%d %H:%M:%S') AS last_seen, record_id AS evidence FROM kyc
UNION ALL """ + link_sql("kind = 'REGISTERED_PHONE'"))
def links_owns_phone(spark, folder):
    opened = tables.prepared_kyc(spark, folder).withColumn("person_id", F.regexp_replace("account_id", "^A", "P-"))
    return link_rows(links.fold_links(links.owns_events(opened).unionByName(links.phone_events(opened))))


@question("""
SELECT src, dst, array_to_string(evidence_ids, ',') AS evidence, len(evidence_ids) AS cited, weight
FROM links WHERE kind = 'LOGGED_IN_FROM'""")
def links_evidence_first20(spark, folder):
    """Two half streams folded on their own and then merged give the links of the whole stream."""
    events = links.login_events(tables.logins(spark, folder))
    middle = events.agg(F.expr("(min(arrival) + max(arrival)) div 2")).first()[0] or 0
    first = links.fold_events(events.filter(F.col("arrival") <= middle), 0)
    second = links.fold_events(events.filter(F.col("arrival") > middle), 1)
    return links.as_links(links.merge_folds(first.unionByName(second))).select(
        "src", "dst", F.array_join("evidence_ids", ",").alias("evidence"),
        F.size("evidence_ids").cast("bigint").alias("cited"), "weight")


MONEY = f""",
recent AS (SELECT * FROM transactions
           WHERE ts >= TIMESTAMP '{NOW:%Y-%m-%d}' - to_days({DAYS})),
sides AS (
  SELECT to_account AS account_id, from_account AS counterparty, 'in' AS direction, txn_id, ts, amount_zar AS amount
  FROM recent UNION ALL
  SELECT from_account, to_account, 'out', txn_id, ts, amount_zar FROM recent),
per_cp AS (SELECT account_id, counterparty, direction, count(*) AS n, sum(amount) AS total
           FROM sides GROUP BY account_id, counterparty, direction),
top_cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id
           ORDER BY total DESC, counterparty, direction) AS rank FROM per_cp) WHERE rank <= 5),
top_tx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id
           ORDER BY amount DESC, txn_id) AS rank FROM sides) WHERE rank <= 5),
totals AS (
  SELECT account_id, count(*) FILTER (WHERE direction = 'in') AS inbound_count,
         round(coalesce(CAST(sum(amount) FILTER (WHERE direction = 'in') AS DOUBLE), 0), 2) AS inbound_total_zar,
         count(*) FILTER (WHERE direction = 'out') AS outbound_count,
         round(coalesce(CAST(sum(amount) FILTER (WHERE direction = 'out') AS DOUBLE), 0), 2) AS outbound_total_zar,
         round(coalesce(CAST(sum(amount) FILTER (WHERE direction = 'out') AS DOUBLE), 0)
               / CAST(sum(amount) FILTER (WHERE direction = 'in') AS DOUBLE), 3) AS pass_through_ratio,
         count(DISTINCT counterparty) FILTER (WHERE direction = 'in') AS distinct_senders,
         count(DISTINCT counterparty) FILTER (WHERE direction = 'out') AS distinct_receivers,
         min(ts) AS first_ts, max(ts) AS last_ts
  FROM sides GROUP BY account_id),
tops AS (SELECT account_id, string_agg(counterparty || ' ' || direction || ' ' || CAST(n AS VARCHAR) || ' '
         || printf('%.2f', CAST(total AS DOUBLE)), ',' ORDER BY rank) AS top_counterparties
         FROM top_cp GROUP BY account_id),
cited AS (SELECT account_id, string_agg(txn_id, ',' ORDER BY rank) AS evidence FROM top_tx GROUP BY account_id)
"""
SUMMARY_SQL = """
SELECT account_id, inbound_count, inbound_total_zar, outbound_count, outbound_total_zar, pass_through_ratio,
       distinct_senders, distinct_receivers, strftime(first_ts, '%Y-%m-%d') AS first_seen,
       strftime(last_ts, '%Y-%m-%d') AS last_seen, top_counterparties, evidence
FROM totals JOIN tops USING (account_id) JOIN cited USING (account_id)"""


def summary_rows(answers):
    top = F.transform("top_counterparties", lambda t: F.format_string(
        "%s %s %d %.2f", t["account_id"], t["direction"], t["count"], t["total_zar"]))
    return answers.select(
        "account_id", "inbound_count", "inbound_total_zar", "outbound_count", "outbound_total_zar",
        "pass_through_ratio", "distinct_senders", "distinct_receivers",
        F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"),
        F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"),
        F.array_join(top, ",").alias("top_counterparties"), F.array_join("evidence_ids", ",").alias("evidence"))


@question(MONEY + SUMMARY_SQL)
def account_summary_all(spark, folder):
    return summary_rows(summary.account_summary(tables.transactions(spark, folder), NOW, DAYS))


@question(MONEY + SUMMARY_SQL + " WHERE account_id = (SELECT max(to_account) FROM transactions)")
def account_summary_one(spark, folder):
    """The question about one account: the last one that received money."""
    sent = tables.transactions(spark, folder)
    asked = sent.agg(F.max("to_account")).first()[0]
    return summary_rows(summary.account_summary(sent, NOW, DAYS, [asked]))


@question(MONEY + """
SELECT account_id, counterparty, direction, n, CAST(total AS DOUBLE) AS total_zar, rank FROM top_cp""")
def top_counterparties(spark, folder):
    recent = summary.in_window(tables.transactions(spark, folder), NOW, DAYS)
    return summary.top_counterparties(recent).select(
        "account_id", "counterparty", "direction", "n", F.col("total").cast("double").alias("total_zar"),
        F.col("rank").cast("bigint").alias("rank"))


@question(MONEY + "SELECT account_id, txn_id, CAST(amount AS DOUBLE) AS amount, rank FROM top_tx")
def top_evidence_transfers(spark, folder):
    recent = summary.in_window(tables.transactions(spark, folder), NOW, DAYS)
    return summary.top_transfers(recent).select(
        "account_id", "txn_id", F.col("amount").cast("double").alias("amount"), F.col("rank").cast("bigint").alias("rank"))


@question(MONEY + """
SELECT account_id, inbound_total_zar, outbound_total_zar, pass_through_ratio FROM totals
WHERE pass_through_ratio BETWEEN 0.8 AND 1.0""")
def pass_through(spark, folder):
    """Accounts that forward nearly all they receive."""
    recent = summary.in_window(tables.transactions(spark, folder), NOW, DAYS)
    return summary.totals(summary.counterparties(recent)).filter("pass_through_ratio between 0.8 and 1.0").select(
        "account_id", "inbound_total_zar", "outbound_total_zar", "pass_through_ratio")
