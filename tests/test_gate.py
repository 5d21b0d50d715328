"""The gate: one reason per damaged field, all plausibility reasons, defaults, poison."""

import datetime as dt
import json

import pytest

from casetrail.operators.validate import dead_letters, validate

NOW = dt.datetime(2023, 4, 20, tzinfo=dt.timezone.utc)
TRANSFER = {"txn_id": "T7310042", "ts": "2023-04-02T23:59:01+02:00", "from_account": "A440017",
            "to_account": "A440903", "amount_zar": 81.35, "channel": "ussd", "reference": "bus tickets"}
OPENING = {"record_id": "KYC-730155", "account_id": "A440017", "full_name": "Ingrid van Aswegen",
           "date_of_birth": "1971-11-30", "phone": "+27 71 555 0198", "email": "ingrid@mail.test", "city": "Upington",
           "opened_at": "2021-06-15T08:30:00Z"}
LOGIN = {"event_id": "L7310001", "ts": "2023-04-03T05:06:07Z", "account_id": "A440017", "device_id": "D-00c0ffee",
         "ip": "203.0.113.99", "success": False}
ENTRY = {"entry_id": "S-512", "full_name": "Harald Quist", "list_name": "HARBOUR LIST"}
NOTE = {"note_id": "N-73100", "account_id": "A440017", "author": "desk 4", "created_at": "2023-04-04T12:00:00Z",
        "text": "called back, no answer"}
GONE = object()


def changed(record, **fields):
    out = {**record, **fields}
    return json.dumps({k: v for k, v in out.items() if v is not GONE})


def judged(spark, source, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, value string")
    return validate(df, source, NOW).orderBy("n").collect()


CASES = {
    "transactions": (TRANSFER, [
        ({"amount_zar": 0}, "schema: amount_zar: Input should be greater than 0"),
        ({"amount_zar": "NaN"}, "schema: amount_zar: Input should be greater than 0"),
        ({"to_account": "B440903"}, "schema: to_account: String should match"),
        ({"channel": "branch"}, "schema: channel: Input should be 'app', 'web', 'ussd' or 'card'"),
        ({"teller": "m"}, "schema: teller: Extra inputs are not permitted"),
        ({"channel": GONE}, "schema: channel: Field required"),
        ({"channel": GONE, "txn_id": 7310042, "teller": 1}, "schema: txn_id: Input should be a valid string"),
        ({"reference": None}, "schema: reference: Input should be a valid string"),
        ({"ts": "31st of May"}, "schema: ts: Input should be a valid datetime"),
        ({"to_account": "A440017"}, "account sends money to itself"),
        ({"ts": "2023-04-21T00:00:01Z"}, "ts is in the future"),
        ({"amount_zar": 1000000.01}, "amount 1000000.01 exceeds the R1m single-transfer limit"),
    ]),
    "kyc": (OPENING, [
        ({"phone": "+27 51 555 0198"}, "phone is not a valid South African mobile number"),
        ({"phone": "7155501"}, "schema: phone: String should have at least 9 characters"),
        ({"date_of_birth": "2012-02-29"}, "customer age 9 at opening is implausible"),
        ({"date_of_birth": "1971-02-30"}, "schema: date_of_birth: Input should be a valid date"),
        ({"opened_at": "2014-12-31T23:59:59Z"}, "opened_at is before 2015"),
    ]),
    "logins": (LOGIN, [({"device_id": "D-00C0FFEE"}, "schema: device_id"), ({"success": 2}, "schema: success")]),
    "sanctions": (ENTRY, [({"aliases": ["H. Quist", False]}, "schema: aliases.1: Input should be a valid string"),
                          ({"aliases": None}, "schema: aliases: Input should be a valid list")]),
    "case_notes": (NOTE, [({"text": "  too few  "}, "schema: text: String should have at least 10 characters"),
                          ({"created_at": "1999-10-10"}, "created_at is before 2015")]),
}


@pytest.mark.parametrize("source", CASES)
def test_refusals(spark, source):
    good, cases = CASES[source]
    rows = judged(spark, source, [json.dumps(good), *[changed(good, **c) for c, _ in cases], "not json", "[1]"])
    assert rows[0].verdict == "ok" and rows[0].reasons == []
    for row, (_, reason) in zip(rows[1:], cases):
        assert row.verdict == "rejected" and row.model is None
        assert len(row.reasons) == 1 and row.reasons[0].startswith(reason), row.reasons
    assert all(r.reasons[0].startswith("schema: record") for r in rows[-2:])


def test_accepted_forms(spark):
    rows = judged(spark, "transactions", [
        changed(TRANSFER, ts="2023-04-02T21:59:01"), changed(TRANSFER, reference=GONE),
        changed(TRANSFER, txn_id="\u2003T7310043\t"), changed(TRANSFER, amount_zar=1234.56),
        changed(TRANSFER)])
    assert {r.verdict for r in rows} == {"ok"}
    assert rows[0].model.ts == rows[4].model.ts == dt.datetime(2023, 4, 2, 21, 59, 1)
    assert rows[1].model.reference == "" and rows[2].record_id == "T7310043"
    assert str(rows[3].model.amount_zar) == "1234.56"
    words = judged(spark, "logins", [changed(LOGIN, success="off"), changed(LOGIN, success=1)])
    assert [r.model.success for r in words] == [False, True]


def test_all_plausibility_reasons_in_order(spark):
    (row,) = judged(spark, "transactions", [changed(TRANSFER, to_account="A440017", amount_zar=3.5e6, ts="2024-02-02")])
    assert row.reasons == ["ts is in the future", "account sends money to itself",
                           "amount 3500000.00 exceeds the R1m single-transfer limit"]


def test_poison_passes_the_gate_and_is_quarantined(spark):
    df = spark.createDataFrame([("transactions", "raw.transactions", 0, 5, "T7310042",
                                 changed(TRANSFER, reference="two\x00parts"))],
                               "source string, topic string, partition int, offset bigint, key string, value string")
    out = validate(df, "transactions", NOW)
    (row,) = dead_letters(out, NOW).collect()
    assert row.kind == "poison" and "after 3 attempts" in row.reasons[0] and "parts" in row.record
    assert row.offset == 5 and row.dead_lettered_at == dt.datetime(2023, 4, 20)


def test_longer_ids_by_parameter(spark):
    df = spark.createDataFrame([(changed(TRANSFER, txn_id="T123456789"),)], "value string")
    assert validate(df, "transactions", NOW).first().verdict == "rejected"
    assert validate(df, "transactions", NOW, patterns={"txn_id": r"^T\d{7,}$"}).first().verdict == "ok"
