"""Validation, quarantine, exactly-once and normal forms over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from casetrail.functions.dates import age_on
from casetrail.functions.text import normalise_name, normalise_phone, title_case
from casetrail.functions.trigrams import similarity, trigram_codes, trigrams
from casetrail.operators.dedupe import first_arrival, latest_copy, raw_and_merged_counts
from casetrail.operators.reconcile import distinct_dead_letters
from casetrail.operators.validate import dead_letters, validate
from casetrail.plans.registry import question
from casetrail.plans.views_sql import grams, name_norm, pad, phone_norm, sim
from casetrail.session import cut, scratch, spread
from casetrail.sources import tables
from casetrail.sources.ledger import Ledger
from casetrail.sources.store import without_prefix
from casetrail.sources.topics import source_of_topic
from casetrail.streaming.ingest import judge, outcome_table, split_outcomes

# Bounds that suit the given data (1995-2001); ids keep their shape and may be longer.
BOUNDS = {
    "now": datetime(2000, 12, 1), "earliest": datetime(1996, 1, 1), "max_transfer": 400_000.0,
    "patterns": {"record_id": r"^KYC-\d{6,}$", "txn_id": r"^T\d{7,}$", "account_id": r"^A\d{6,}$",
                 "from_account": r"^A\d{6,}$", "to_account": r"^A\d{6,}$"},
}
KYC_BOUNDS = {**BOUNDS, "now": datetime(2020, 1, 1), "earliest": datetime(2016, 1, 15)}


def sent_transfers(spark, folder):
    """Transfers as messages: some with an unknown field, money below zero, or a NUL in the text."""
    # Writing and judging JSON costs more than reading: the files' splits would be too few tasks.
    sent = spread(tables.transfers(spark, folder), "txn_id")
    damaged = sent.withColumns({
        "amount_zar": F.col("amount_zar") - 20000,
        "memo": F.when(F.col("reference") == "order P", "x"),
        "reference": F.when((F.col("reference") == "order F") & (F.col("channel") == "ussd"),
                            F.concat("reference", F.char(F.lit(0)))).otherwise(F.col("reference"))})
    return tables.as_messages(damaged, "transactions", "txn_id")


def sent_openings(spark, folder):
    """Openings as messages with phones of every first digit and birth dates over 120 years."""
    opened = tables.kyc(spark, folder)
    number = 500000000 + (F.col("arrival") % 5) * 100000000 + F.floor(F.col("arrival") / 3)
    damaged = opened.withColumns({
        "phone": F.concat(F.lit("+27 (0)").substr(1, 4), number.cast("string")),
        "date_of_birth": F.date_add(F.lit("1900-01-01").cast("date"), (F.col("arrival") * 37 % 45000).cast("int"))})
    return tables.as_messages(damaged, "kyc", "record_id")


DAMAGED = f""",
damaged AS (
  SELECT txn_id AS key, arrival, ts, from_account, to_account, amount_zar - 20000 AS amount, channel, reference,
         (reference = 'order F' AND channel = 'ussd') AS nul,
         CASE WHEN amount_zar - 20000 <= 0 THEN 'schema: amount_zar: Input should be greater than 0'
              WHEN channel = 'fax' THEN 'schema: channel: Input should be ''app'', ''web'', ''ussd'' or ''card'''
              WHEN reference = 'order P' THEN 'schema: memo: Extra inputs are not permitted' END AS schema_error
  FROM transfers),
judged AS (
  SELECT *, CASE WHEN len(why) > 0 THEN 'rejected' WHEN nul THEN 'poison' ELSE 'ok' END AS verdict,
         CASE WHEN len(why) = 0 AND nul
              THEN ['processing error after 3 attempts: text holds a NUL character'] ELSE why END AS reasons
  FROM (SELECT *, CASE WHEN schema_error IS NOT NULL THEN [schema_error] ELSE list_filter([
      CASE WHEN ts > TIMESTAMP '2000-12-02' THEN 'ts is in the future' END,
      CASE WHEN ts < TIMESTAMP '1996-01-01' THEN 'ts is before 1996' END,
      CASE WHEN from_account = to_account THEN 'account sends money to itself' END,
      CASE WHEN amount > 400000 THEN 'amount ' || printf('%.2f', amount)
                || ' exceeds the R1m single-transfer limit' END], lambda r: r IS NOT NULL) END AS why
    FROM damaged))
"""


@question(DAMAGED + "SELECT key, verdict, array_to_string(reasons, '; ') AS reasons FROM judged")
def validate_transactions(spark, folder):
    judged = validate(sent_transfers(spark, folder), "transactions", **BOUNDS)
    return judged.select("key", "verdict", F.array_join("reasons", "; ").alias("reasons"))


@question(f""",
shaped AS (
  SELECT record_id AS key, opened_at,
         500000000 + (arrival % 5) * 100000000 + arrival // 3 AS number,
         DATE '1900-01-01' + CAST(arrival * 37 % 45000 AS INTEGER) AS dob FROM kyc),
aged AS (SELECT *, year(opened_at) - year(dob)
                   - CAST(strftime(opened_at, '%m%d') < strftime(dob, '%m%d') AS INTEGER) AS age FROM shaped),
judged AS (
  SELECT key, list_filter([
      CASE WHEN opened_at > TIMESTAMP '2020-01-02' THEN 'opened_at is in the future' END,
      CASE WHEN opened_at < TIMESTAMP '2016-01-15' THEN 'opened_at is before 2016' END,
      CASE WHEN number < 600000000 OR number >= 900000000
           THEN 'phone is not a valid South African mobile number' END,
      CASE WHEN age NOT BETWEEN 16 AND 110
           THEN 'customer age ' || CAST(age AS VARCHAR) || ' at opening is implausible' END],
      lambda r: r IS NOT NULL) AS reasons FROM aged)
SELECT key, CASE WHEN len(reasons) > 0 THEN 'rejected' ELSE 'ok' END AS verdict,
       array_to_string(reasons, '; ') AS reasons FROM judged""")
def validate_openings(spark, folder):
    judged = validate(sent_openings(spark, folder), "kyc", **KYC_BOUNDS)
    return judged.select("key", "verdict", F.array_join("reasons", "; ").alias("reasons"))


@question(DAMAGED + """
SELECT verdict AS kind, 'transactions' AS source, array_to_string(reasons, '; ') AS reasons,
       'raw.transactions' AS topic, arrival AS "offset", key
FROM judged WHERE verdict <> 'ok'""")
def quarantine_rows(spark, folder):
    judged = validate(sent_transfers(spark, folder), "transactions", **BOUNDS)
    return dead_letters(judged, BOUNDS["now"]).select(
        "kind", "source", F.array_join("reasons", "; ").alias("reasons"), "topic", "offset", "key")


def delivered_twice(messages, shift: int = 10 ** 12):
    """The stream followed by a second copy of itself."""
    return messages.unionByName(messages.withColumn("offset", F.col("offset") + shift))


@question(DAMAGED + """
SELECT verdict AS kind, count(DISTINCT key) AS n FROM judged WHERE verdict <> 'ok' GROUP BY verdict""")
def distinct_dead_letters_after_replay(spark, folder):
    judged = validate(delivered_twice(sent_transfers(spark, folder)), "transactions", **BOUNDS)
    return distinct_dead_letters(dead_letters(judged, BOUNDS["now"]))


@question(DAMAGED + """
SELECT 'transactions' AS source, count(*) FILTER (WHERE verdict = 'ok') AS applied,
       count(*) FILTER (WHERE verdict = 'ok') AS duplicate,
       2 * count(*) FILTER (WHERE verdict = 'rejected') AS rejected,
       2 * count(*) FILTER (WHERE verdict = 'poison') AS poison FROM judged
UNION ALL
SELECT 'logins', count(*), count(*), 0, 0 FROM logins""")
def validate_outcome_counts(spark, folder):
    """Everything delivered twice to an empty ledger."""
    logins = tables.as_messages(tables.logins(spark, folder), "logins", "event_id")
    messages = delivered_twice(sent_transfers(spark, folder).unionByName(logins))
    bounds = {**BOUNDS, "now": datetime(2024, 3, 1), "earliest": datetime(1996, 1, 1)}
    judged = judge(messages, sources=["transactions"], **BOUNDS).drop("transactions").unionByName(
        judge(messages, sources=["logins"], **bounds).drop("logins"))
    judged = cut(judged.select("source", "offset", "partition", "row", "event_key", "verdict"))
    fresh, refused = split_outcomes(judged, lambda df: df)
    return outcome_table(judged, fresh, refused)


LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus"]
LINE_SHOWN = [*LINE_KEY, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in LINE_ORDER)
    return (f"SELECT {', '.join(LINE_SHOWN)} FROM (SELECT *, row_number() OVER (PARTITION BY "
            f"{', '.join(LINE_KEY)} ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1")


@question(line_sql("ASC"), views=False)
def dedupe_first_arrival(spark, folder):
    lines = tables.table(spark, folder, "lineitem")
    return first_arrival(lines, LINE_KEY, [F.col(c) for c in LINE_ORDER]).select(*LINE_SHOWN)


@question(line_sql("DESC"), views=False)
def replacing_merge_read(spark, folder):
    lines = tables.table(spark, folder, "lineitem")
    return latest_copy(lines, LINE_KEY, [F.col(c) for c in LINE_ORDER]).select(*LINE_SHOWN)


@question("""SELECT count(*) AS rows_stored, count(DISTINCT (l_orderkey, l_linenumber)) AS rows_distinct
FROM lineitem""", views=False)
def replacing_merge_count(spark, folder):
    return raw_and_merged_counts(tables.table(spark, folder, "lineitem"), LINE_KEY)


@question("""
SELECT DISTINCT 'orders:' || CAST(l_orderkey AS VARCHAR) AS event_key FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""", views=False)
def ledger_antijoin(spark, folder):
    """Line deliveries against a stored ledger of finished orders, three versions by date."""
    lines = tables.table(spark, folder, "lineitem").select(
        F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("event_key")).distinct()
    done = tables.table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(
        "o_orderdate", F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("event_key"))
    ledger = Ledger(spark, scratch(spark, "ledger"))
    early, late = F.col("o_orderdate") < "1993-06-01", F.col("o_orderdate") >= "1994-06-01"
    for version, part in enumerate([early, ~early & ~late, late]):
        ledger.append(done.filter(part), version)
    return ledger.unseen(lines, 2)


@question(f"SELECT record_id, {phone_norm('phone')} AS phone_e164 FROM kyc")
def phone_normalise(spark, folder):
    return tables.kyc(spark, folder).select("record_id", normalise_phone(F.col("phone")).alias("phone_e164"))


@question(f"SELECT doc_id, {name_norm('text')} AS name_norm FROM documents", views=False)
def name_normalise(spark, folder):
    """The name rule over whole document texts: accents, punctuation, titles in four languages."""
    return spread(tables.table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", normalise_name(F.col("text")).alias("name_norm"))


@question("""
SELECT record_id, year(opened_at) - year(date_of_birth)
       - CAST(strftime(opened_at, '%m%d') < strftime(date_of_birth, '%m%d') AS INTEGER) AS age FROM kyc""")
def age_at_opening(spark, folder):
    opened = tables.kyc(spark, folder)
    return opened.select("record_id", age_on(F.col("date_of_birth"), F.col("opened_at")).cast("bigint").alias("age"))


@question("""
SELECT record_id, array_to_string(list_transform(string_split(full_name, ' '),
       lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS display_name FROM kyc""")
def title_case_names(spark, folder):
    return tables.kyc(spark, folder).select("record_id", title_case(F.col("full_name")).alias("display_name"))


@question(f"SELECT record_id, array_to_string(list_sort({grams('name_norm')}), '|') AS trigrams FROM kycp")
def name_trigrams(spark, folder):
    return tables.prepared_kyc(spark, folder).select(
        "record_id", F.array_join(F.array_sort(trigrams(F.col("name_norm"))), "|").alias("trigrams"))


@question(f"""
SELECT c_custkey, round({sim('a', 'b')}, 6) AS similarity FROM (
  SELECT c_custkey, {grams("lower(p_name || ' ' || c_mktsegment)")} AS a, {grams("lower(p_type || ' ' || p_name)")} AS b
  FROM customer JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part))""", views=False)
def name_similarity(spark, folder):
    customer, part = tables.table(spark, folder, "customer"), tables.table(spark, folder, "part")
    both = spread(customer.join(part, F.col("p_partkey") == F.col("c_custkey") % part.count()).select(
        "c_custkey", "p_name", "c_mktsegment", "p_type"))
    a = trigram_codes(normalise_name(F.concat_ws(" ", "p_name", "c_mktsegment")))
    b = trigram_codes(normalise_name(F.concat_ws(" ", "p_type", "p_name")))
    # Worked out once: without `inline` the sets would be repeated wherever the similarity names them.
    sets = both.select("c_custkey", F.inline(F.array(F.struct(a.alias("a"), b.alias("b")))))
    return sets.select("c_custkey", F.round(similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@question("""
SELECT event_type, 'raw.' || event_type AS topic, count(*) AS n FROM events GROUP BY event_type""", views=False)
def topic_routing(spark, folder):
    events = tables.table(spark, folder, "events").select(F.concat(F.lit("raw."), "event_type").alias("topic"))
    return (events.withColumn("event_type", source_of_topic(F.col("topic")))
            .groupBy("event_type", "topic").agg(F.count("*").alias("n")))


@question(f"""SELECT txn_id, CAST(amount_zar AS DOUBLE) AS amount_zar FROM (
  SELECT {pad('T', 'o_orderkey', 7)} AS txn_id, o_totalprice AS amount_zar FROM orders)
WHERE NOT starts_with(txn_id, 'T00009')""", views=False)
def without_drill_rows(spark, folder):
    """A snapshot of the transfers without one id range."""
    sent = tables.transfers(spark, folder).select("txn_id", F.col("amount_zar").cast("double").alias("amount_zar"))
    return without_prefix(sent, "T00009")
