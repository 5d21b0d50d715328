"""Dates and timestamps. The session time zone is UTC, so a value without a zone is UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIMESTAMP = (r"^\d{4}-\d{2}-\d{2}"
                 r"([Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$")


def age_on(born: Column, day: Column) -> Column:
    """Full years lived; someone born on 29 February turns older on 1 March."""
    before_birthday = F.date_format(day, "MMdd") < F.date_format(born, "MMdd")
    return F.year(day) - F.year(born) - before_birthday.cast("int")


def parse_timestamp(text: Column) -> Column:
    tidy = F.replace(F.upper(text), F.lit("_"), F.lit("T"))
    return F.when(text.rlike(ISO_TIMESTAMP), tidy.try_cast("timestamp"))


def own_date(text: Column) -> Column:
    """Calendar date in the zone the record was written in."""
    return F.substring(text, 1, 10).try_cast("date")


def parse_date(text: Column) -> Column:
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def instant(at: datetime) -> Column:
    """A fixed point in time; a datetime without a zone is UTC."""
    if at.tzinfo:
        at = at.astimezone(timezone.utc)
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def utc_now() -> datetime:
    return datetime.now(timezone.utc)
