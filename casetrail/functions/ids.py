"""Typed node ids, person numbers, and what kind of thing a search text names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail.functions.text import normalise_phone

# Id formats a search text is compared with, in this order. Numbers grow beyond the usual width.
ID_FORMATS = {
    "account": r"^A\d{6,}$",
    "person": r"^P-\d{6,}$",
    "device": r"^D-[0-9a-f]{8}$",
    "sanction": r"^S-\d{3,}$",
}
# Kinds of nodes and the form of their ids.
NODE_KINDS = ["person", "account", "phone", "device", "sanction"]
NODE_ID = r"^(person|account|phone|device|sanction):.+$"


def node(kind: str, ident: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), ident)


def node_kind(node_id: Column) -> Column:
    return F.substring_index(node_id, ":", 1)


def node_ident(node_id: Column) -> Column:
    return F.regexp_extract(node_id, r"^[^:]*:(.*)$", 1)


def person_id(ordinal: Column) -> Column:
    """P- and at least six digits; longer numbers are kept whole."""
    digits = ordinal.cast("string")
    return F.concat(F.lit("P-"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")))


def query_kind(text: Column) -> Column:
    """account, person, device, sanction, phone or name."""
    chain = None
    for kind, pattern in ID_FORMATS.items():
        test = text.rlike(pattern)
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.when(normalise_phone(text).isNotNull(), "phone").otherwise("name")


def event_key(source: Column, record_id: Column) -> Column:
    return F.concat_ws(":", source, record_id)
