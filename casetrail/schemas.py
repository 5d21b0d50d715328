"""Fixed values of the data model: sources, topics, field rules, link kinds, table schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    name: str
    type: str                       # string, date, timestamp, double, boolean, array<string>
    pattern: str | None = None
    min_len: int | None = None
    max_len: int | None = None
    choices: tuple[str, ...] = ()
    positive: bool = False
    required: bool = True
    nullable: bool = False


@dataclass(frozen=True)
class Source:
    name: str
    id_field: str
    fields: tuple[Field, ...]
    time_field: str | None = None

    @property
    def topic(self) -> str:
        return f"raw.{self.name}"


ACCOUNT = r"^A\d{6}$"

# The five sources with their field rules, in publishing order.
SOURCES = {s.name: s for s in [
    Source("sanctions", "entry_id", (
        Field("entry_id", "string", pattern=r"^S-\d{3}$"),
        Field("full_name", "string", min_len=2, max_len=120),
        Field("date_of_birth", "date", required=False, nullable=True),
        Field("list_name", "string"),
        Field("aliases", "array<string>", required=False),
    )),
    Source("kyc", "record_id", (
        Field("record_id", "string", pattern=r"^KYC-\d{6}$"),
        Field("account_id", "string", pattern=ACCOUNT),
        Field("full_name", "string", min_len=2, max_len=120),
        Field("date_of_birth", "date"),
        Field("phone", "string", min_len=9, max_len=20),
        Field("email", "string", max_len=120, required=False, nullable=True),
        Field("city", "string", min_len=2, max_len=60),
        Field("opened_at", "timestamp"),
    ), "opened_at"),
    Source("logins", "event_id", (
        Field("event_id", "string", pattern=r"^L\d{7}$"),
        Field("ts", "timestamp"),
        Field("account_id", "string", pattern=ACCOUNT),
        Field("device_id", "string", pattern=r"^D-[0-9a-f]{8}$"),
        Field("ip", "string", min_len=7, max_len=45),
        Field("success", "boolean"),
    ), "ts"),
    Source("transactions", "txn_id", (
        Field("txn_id", "string", pattern=r"^T\d{7}$"),
        Field("ts", "timestamp"),
        Field("from_account", "string", pattern=ACCOUNT),
        Field("to_account", "string", pattern=ACCOUNT),
        Field("amount_zar", "double", positive=True),
        Field("channel", "string", choices=("app", "web", "ussd", "card")),
        Field("reference", "string", max_len=140, required=False),
    ), "ts"),
    Source("case_notes", "note_id", (
        Field("note_id", "string", pattern=r"^N-\d{5}$"),
        Field("account_id", "string", pattern=ACCOUNT),
        Field("author", "string"),
        Field("created_at", "timestamp"),
        Field("text", "string", min_len=10, max_len=2000),
    ), "created_at"),
]}
PUBLISH_ORDER = list(SOURCES)

# Outcomes of one message, link kinds, kinds that say who somebody is.
OUTCOMES = ["applied", "duplicate", "rejected", "poison"]
LINK_KINDS = ["OWNS", "REGISTERED_PHONE", "LOGGED_IN_FROM", "SENT_TO", "SANCTIONS_MATCH"]
IDENTITY_KINDS = ["OWNS", "REGISTERED_PHONE", "SANCTIONS_MATCH"]
MAX_EVIDENCE = 20

RAW = (
    "source string, topic string, partition int, offset bigint, key string, value string")
PERSONS = (
    "person_no bigint, person_id string, display_name string, name_norm string, date_of_birth date, "
    "city string, created_from string, arrival bigint")
ACCOUNTS = (
    "account_id string, person_id string, full_name string, name_norm string, phone_e164 string, "
    "email string, city string, opened_at timestamp, kyc_evidence_id string, matched_rule string, "
    "date_of_birth date, person_dob date, arrival bigint")
SANCTIONS = (
    "entry_id string, full_name string, name_norm string, aliases_norm array<string>, "
    "date_of_birth date, list_name string")
LINKS = (
    "src string, dst string, kind string, weight bigint, total_zar decimal(16,2), score double, "
    "first_seen timestamp, last_seen timestamp, evidence_ids array<string>")
TRANSACTIONS = (
    "txn_id string, ts timestamp, from_account string, to_account string, amount_zar decimal(14,2), "
    "channel string, reference string")
NOTES = (
    "note_id string, account_id string, author string, created_at timestamp, text string")
EVIDENCE = (
    "evidence_id string, source string, payload string, received_at timestamp")
QUARANTINE = (
    "kind string, source string, reasons array<string>, record string, topic string, partition int, "
    "offset bigint, key string, dead_lettered_at timestamp")


def columns(ddl: str) -> list[str]:
    """Column names of one of the schemas above."""
    flat = re.sub(r"\([^)]*\)", "", ddl)
    while "<" in flat:
        flat = re.sub(r"<[^<>]*>", "", flat)
    return [part.split()[0] for part in flat.split(",")]
