"""The gate on logins, sanctions entries and notes: missing and null fields, lists, booleans, lengths, zones."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail.operators.validate import WHITE_SPACE, validate
from casetrail.plans.registry import question
from casetrail.sources import tables

BOUNDS = {
    "now": datetime(2026, 1, 1), "earliest": datetime(1990, 1, 1),
    "patterns": {"event_id": r"^L\d{7,}$", "account_id": r"^A\d{6,}$", "entry_id": r"^S-\d{3,}$", "note_id": r"^N-\d{5,}$"},
}
SECONDS = "yyyy-MM-dd HH:mm:ss"
SPACES = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def shown() -> list:
    return ["key", "verdict", F.array_join("reasons", "; ").alias("reasons")]


def record(*parts) -> Column:
    """JSON text from literal pieces and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def by_case(number: Column, forms: dict[int, Column], otherwise: Column) -> Column:
    out = otherwise
    for case, form in forms.items():
        out = F.when(number == case, form).otherwise(out)
    return out


@question("""
SELECT event_id AS key, CASE WHEN arrival % 9 IN (0, 1, 5, 6) THEN 'ok' ELSE 'rejected' END AS verdict,
       CASE arrival % 9 WHEN 2 THEN 'schema: success: Input should be a valid boolean'
            WHEN 3 THEN 'schema: device_id: Field required' WHEN 4 THEN 'schema: ip: Input should be a valid string'
            WHEN 7 THEN 'schema: ip: String should have at least 7 characters'
            WHEN 8 THEN 'schema: os: Extra inputs are not permitted' ELSE '' END AS reasons,
       CASE WHEN arrival % 9 IN (0, 1, 5, 6) THEN account_id END AS account_id,
       CASE WHEN arrival % 9 IN (0, 1, 5, 6) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
       CASE WHEN arrival % 9 IN (0, 1, 5, 6) THEN success END AS success
FROM logins""")
def validate_logins(spark, folder):
    """Words as booleans, an own time zone, spaces around ids; missing, null, short and unknown fields."""
    sent = tables.logins(spark, folder)
    case, local = F.col("arrival") % 9, F.col("ts") + F.expr("INTERVAL 2 HOURS")
    time = by_case(case, {6: record(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), "+02:00")},
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    yes = by_case(case, {1: F.when(F.col("success"), '"Yes"').otherwise('"OFF"'), 2: F.lit("2")},
                  F.col("success").cast("string"))
    device = by_case(case, {3: F.lit("")}, record('"device_id":"', F.col("device_id"), '",'))
    ip = by_case(case, {4: F.lit("null"), 7: F.lit('" 1.2  "')}, record('"', F.col("ip"), '"'))
    account = by_case(case, {5: record("  ", F.col("account_id"), "\\t")}, F.col("account_id"))
    extra = by_case(case, {8: F.lit(',"os":"x"')}, F.lit(""))
    value = record('{"event_id":"', F.col("event_id"), '","ts":"', time, '","account_id":"', account, '",', device,
                   '"ip":', ip, ',"success":', yes, extra, "}")
    judged = validate(tables.as_messages(sent, "logins", "event_id", value), "logins", **BOUNDS)
    return judged.select(*shown(), "model.account_id", F.date_format("model.ts", SECONDS).alias("ts"), "model.success")


@question("""
SELECT entry_id AS key, CASE WHEN s_suppkey % 6 < 2 THEN 'ok' ELSE 'rejected' END AS verdict,
       CASE s_suppkey % 6 WHEN 2 THEN 'schema: aliases.1: Input should be a valid string'
            WHEN 3 THEN 'schema: aliases: Input should be a valid list'
            WHEN 4 THEN 'schema: full_name: String should have at least 2 characters'
            WHEN 5 THEN 'schema: list_name: Field required' ELSE '' END AS reasons,
       CASE s_suppkey % 6 WHEN 0 THEN s_name || ',other' WHEN 1 THEN '' END AS aliases,
       CASE WHEN s_suppkey % 6 < 2 THEN s_name END AS full_name
FROM (SELECT *, 'S-' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0')
             AS entry_id FROM supplier)""", views=False)
def validate_entries(spark, folder):
    """Lists with and without wrong members, a list that is none, defaults, a name of one letter."""
    supplier = tables.table(spark, folder, "supplier").withColumn("entry_id", tables.padded("S-", F.col("s_suppkey"), 3))
    case, name = F.col("s_suppkey") % 6, F.col("s_name")
    aliases = by_case(case, {1: F.lit(""), 2: F.lit(',"aliases":["x",3]'), 3: F.lit(',"aliases":"x"')},
                      record(',"aliases":["', name, '"," other "]'))
    listed = by_case(case, {5: F.lit("")}, F.lit(',"list_name":"HARBOUR"'))
    born = by_case(case, {0: F.lit(',"date_of_birth":null')}, F.lit(""))
    value = record('{"entry_id":"', F.col("entry_id"), '","full_name":"', by_case(case, {4: F.lit(" q ")}, name), '"',
                   born, listed, aliases, "}")
    rows = supplier.select("entry_id", F.col("s_suppkey").alias("arrival"), value.alias("body"))
    judged = validate(tables.as_messages(rows, "sanctions", "entry_id", F.col("body")), "sanctions", **BOUNDS)
    return judged.select(*shown(), F.array_join("model.aliases", ",").alias("aliases"), "model.full_name")


@question(f"""
SELECT key, CASE WHEN reasons = '' THEN 'ok' ELSE 'rejected' END AS verdict, reasons,
       CASE WHEN reasons = '' THEN strftime(made, '%Y-%m-%d %H:%M:%S') END AS created_at FROM (
  SELECT 'N-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS key,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 500000 AS INTEGER)) AS made,
         CASE WHEN doc_id % 4 = 2 THEN 'schema: author: Field required'
              WHEN doc_id % 4 = 3 THEN 'schema: created_at: Input should be a valid datetime'
              WHEN length(trim(text, {SPACES})) < 10 THEN 'schema: text: String should have at least 10 characters'
              WHEN length(trim(text, {SPACES})) > 2000 THEN 'schema: text: String should have at most 2000 characters'
              ELSE '' END AS reasons FROM documents)""", views=False)
def validate_notes(spark, folder):
    """Whole texts against the length rules; epoch seconds, UTC times and times that are none."""
    notes = tables.notes(spark, folder).withColumn("arrival", F.regexp_replace("note_id", "^N-0*(?=.)", "").cast("bigint"))
    case = F.col("arrival") % 4
    time = by_case(case, {1: F.unix_timestamp("created_at").cast("string"), 3: F.lit('"some day"')},
                   record('"', F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), 'Z"'))
    author = by_case(case, {2: F.lit("")}, F.lit('"author":"desk",'))
    # to_json escapes the text; its braces are cut off to join it with the other fields.
    text = F.to_json(F.struct("text"))
    value = record('{"note_id":"', F.col("note_id"), '","account_id":"', F.col("account_id"), '",', author,
                   '"created_at":', time, ",", F.substring(text, F.lit(2), F.length(text)))
    judged = validate(tables.as_messages(notes, "case_notes", "note_id", value), "case_notes", **BOUNDS)
    return judged.select(*shown(), F.date_format("model.created_at", SECONDS).alias("created_at"))
