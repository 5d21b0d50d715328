"""Every registered question against its SQL on the smallest tables.

The ingest streams are left to test_streaming.py here, because they take half a minute to two minutes each; run
`python tests/compare.py 0.01` for all of them.
"""

import pytest
from compare import compare, connect

from casetrail.plans import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
SLOW = {"stream_ingest_links", "stream_ingest_outcomes", "stream_stored_evidence", "resolve_rule_counts", "stream_whole_links",
        "stream_persons", "stream_restart_outcomes", "stream_live_counters", "stream_account_summary",
        "stream_bounded_copies", "stream_evidence_fetch"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_question(spark, duck, name):
    same, note = compare(spark, duck, FOLDER, name, QUERIES[name], ORACLE.get(name))
    assert same, note


def test_every_question_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__ as driver

    out = driver.entry(spark)
    assert out.columns[0] == "account_id" and out.count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
