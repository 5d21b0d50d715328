"""The views of casetrail.sources.tables as SQL, and SQL forms of the scalar functions."""

from __future__ import annotations


def pad(prefix: str, number: str, digits: int) -> str:
    return (f"('{prefix}' || lpad(CAST({number} AS VARCHAR), "
            f"CAST(greatest({digits}, length(CAST({number} AS VARCHAR))) AS INTEGER), '0'))")


def name_norm(col: str) -> str:
    words = f"string_split(regexp_replace(strip_accents({col}), '[^A-Za-z]+', ' ', 'g'), ' ')"
    titles = "['mr','mrs','ms','miss','dr','prof','mama','baba','rev']"
    return (f"array_to_string(list_filter(list_transform({words}, lambda w: lower(w)), "
            f"lambda w: w <> '' AND NOT list_contains({titles}, w)), ' ')")


def phone_norm(col: str) -> str:
    digits = f"regexp_replace({col}, '[^0-9]', '', 'g')"
    found = f"regexp_extract({digits}, '^(?:27|0)([678][0-9]{{8}})$', 1)"
    return f"(CASE WHEN {found} <> '' THEN '+27' || {found} END)"


def grams(col: str) -> str:
    return (f"list_distinct(flatten(list_transform(list_filter(string_split({col}, ' '), lambda w: w <> ''), "
            f"lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), "
            f"lambda i: substr('  ' || w || ' ', CAST(i AS INTEGER), 3)))))")


def sim(a: str, b: str) -> str:
    """Similarity of two gram lists."""
    both = f"len(list_intersect({a}, {b}))"
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE "
            f"ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)")


def reached(a: str, b: str, num: int, den: int) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(len({a}) > 0 AND len({b}) > 0 AND {den} * {both} >= {num} * (len({a}) + len({b}) - {both}))"


def birth(key: str) -> str:
    return f"(DATE '1950-01-01' + CAST(({key}) * 37 % 50 AS INTEGER))"


VIEWS = f"""
WITH parts AS (SELECT count(*) AS n FROM part), custs AS (SELECT count(*) AS n FROM customer),
kyc AS (
  SELECT {pad('KYC-', 'c_custkey', 6)} AS record_id, {pad('A', 'c_custkey', 6)} AS account_id,
         p_name || ' ' || c_mktsegment AS full_name, {birth('c_custkey // 2')} AS date_of_birth,
         '0' || CAST(600000000 + c_custkey // 3 AS VARCHAR) AS phone,
         CASE WHEN c_custkey % 5 = 0 THEN 'u' || CAST(c_custkey // 10 AS VARCHAR) || '@example.com' END AS email,
         'City' || CAST(c_nationkey % 5 AS VARCHAR) AS city,
         TIMESTAMP '2016-01-01' + to_hours(CAST(c_custkey % 70000 AS INTEGER)) AS opened_at, c_custkey AS arrival
  FROM customer JOIN part ON p_partkey = c_custkey % (SELECT n FROM parts)),
kycp AS (
  SELECT *, {phone_norm('phone')} AS phone_e164, {name_norm('full_name')} AS name_norm, lower(email) AS email_key
  FROM kyc),
accounts AS (
  SELECT account_id, 'P-' || substr(account_id, 2) AS person_id, full_name, name_norm, phone_e164, email, city,
         opened_at, record_id AS kyc_evidence_id, 'NEW' AS matched_rule FROM kycp),
sanctions AS (
  SELECT {pad('S-', 's_suppkey', 3)} AS entry_id, p.p_name || ' BUILDING' AS full_name,
         CASE WHEN s_suppkey % 3 <> 0 THEN {birth('s_suppkey')} END AS date_of_birth,
         'LIST-' || CAST(s_nationkey AS VARCHAR) AS list_name,
         ['Mr ' || o.p_name || ' MACHINERY'] AS aliases
  FROM supplier JOIN part p ON p.p_partkey = s_suppkey % (SELECT n FROM parts)
  JOIN part o ON o.p_partkey = (s_suppkey * 7 + 1) % (SELECT n FROM parts)),
transfers AS (
  SELECT {pad('T', 'o_orderkey', 7)} AS txn_id, o_orderdate AS ts, {pad('A', 'o_custkey', 6)} AS from_account,
         {pad('A', '((o_custkey * 7 + o_orderkey % 3) % (SELECT n FROM custs))', 6)} AS to_account,
         o_totalprice AS amount_zar,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'app' WHEN '2-HIGH' THEN 'web' WHEN '3-MEDIUM' THEN 'ussd'
              WHEN '4-NOT SPECIFIED' THEN 'fax' WHEN '5-LOW' THEN 'card' END AS channel,
         'order ' || o_orderstatus AS reference, o_orderkey AS arrival
  FROM orders),
transactions AS (
  SELECT txn_id, ts, from_account, to_account, CAST(amount_zar AS DECIMAL(14,2)) AS amount_zar, channel,
         reference, arrival
  FROM transfers WHERE channel <> 'fax' AND from_account <> to_account),
logins AS (
  SELECT {pad('L', 'event_id', 7)} AS event_id, ts, {pad('A', 'user_id', 6)} AS account_id,
         'D-' || lpad(lower(to_hex(user_id // 3)), 8, '0') AS device_id, event_type <> 'error' AS success,
         event_id AS arrival
  FROM events),
notes AS (
  SELECT {pad('N-', 'doc_id', 5)} AS note_id, {pad('A', '(doc_id % (SELECT n FROM custs))', 6)} AS account_id,
         source AS author, text FROM documents),
messages AS (
  SELECT conv_id AS run_id, turn AS seq, CASE WHEN role = 'assistant' THEN 'ai' ELSE 'tool' END AS role,
         text AS content, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS tool_calls,
         length(text) AS input_tokens, len(string_split(text, ' ')) AS output_tokens FROM conversations),
link_events AS (
  SELECT 'account:' || from_account AS src, 'account:' || to_account AS dst, 'SENT_TO' AS kind, arrival,
         txn_id AS evidence, ts, amount_zar AS amount FROM transactions
  UNION ALL
  SELECT 'account:' || account_id, 'device:' || device_id, 'LOGGED_IN_FROM', arrival, event_id, ts, NULL
  FROM logins WHERE success
  UNION ALL
  SELECT 'account:' || account_id, 'phone:' || phone_e164, 'REGISTERED_PHONE', arrival, record_id, opened_at, NULL
  FROM kycp),
links AS (
  SELECT src, dst, kind, count(*) AS weight, sum(amount) AS total_zar, min(ts) AS first_seen, max(ts) AS last_seen,
         list(evidence ORDER BY arrival)[1:20] AS evidence_ids
  FROM link_events GROUP BY src, dst, kind)
"""
