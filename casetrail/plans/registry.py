"""Names of the registered questions, their Spark form and, where there is one, their SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casetrail.plans.views_sql import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def question(sql: str | None = None, views: bool = True):
    """Register a function under its own name."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = (VIEWS if views else "") + sql
        return fn
    return register
