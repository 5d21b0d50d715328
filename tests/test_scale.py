"""Work that must spread over the session's tasks whatever the number of files, on rows made here."""

import datetime

import pytest
from pyspark.sql import functions as F

from casetrail.operators import notes
from casetrail.plans import checks
from casetrail.plans.registry import QUERIES
import casetrail.plans.gate  # noqa: F401
import casetrail.plans.writing  # noqa: F401


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given tables in small, one file each."""
    path = str(tmp_path_factory.mktemp("tables"))
    kinds = ["hot bolt", "old plate", "blue ring", "cold plate"]
    day = datetime.datetime(1996, 5, 1)
    made = {
        "part": ([(i, kinds[i % 4], f"LARGE {kinds[i % 3]}") for i in range(8)], "p_partkey bigint, p_name string, p_type string"),
        "customer": ([(i, i % 25, "BUILDING" if i % 2 else "MACHINERY") for i in range(60)],
                     "c_custkey bigint, c_nationkey bigint, c_mktsegment string"),
        "supplier": ([(i, f"Supplier {i}", i % 25) for i in range(30)], "s_suppkey bigint, s_name string, s_nationkey bigint"),
        "orders": ([(i, i % 60, "OFP"[i % 3], 100.0 + i, day + datetime.timedelta(days=i % 300),
                     ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"][i % 5]) for i in range(240)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
                   "o_orderpriority string"),
        "events": ([(i, day, i % 60, "view" if i % 4 else "error") for i in range(90)],
                   "event_id bigint, ts timestamp, user_id bigint, event_type string"),
        "documents": ([(i, f"Dr Zoë Nkosi{i} writes to Mr Dlamini about small deposits", "web") for i in range(40)],
                      "doc_id bigint, text string, source string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def tasks(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("name", ["name_normalise", "name_similarity"])
def test_row_work_uses_all_partitions(spark, folder, name):
    assert tasks(QUERIES[name](spark, folder)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_hashing_moves_no_features(spark, folder):
    """Features are summed in the task that cuts them: no row of the plan is a single feature."""
    df = QUERIES["hash_embedding_buckets"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "MapInArrow" in plan


def test_rows_of_one_key_are_summed(spark):
    df = spark.createDataFrame([(1, "abc abc"), (1, "abc"), (None, "abc"), (None, "abc"), (2, None), (3, "")], "n int, text string")
    got = {(r["n"], abs(r["value"])) for r in notes.sparse_hash(df, "n").collect()}
    assert got == {(1, 6), (None, 4)}


def test_vectors_of_a_question_are_made_once(spark, folder, monkeypatch):
    asked = []
    search = notes.search_notes
    monkeypatch.setattr(notes, "search_notes", lambda df, *more: asked.append(df) or search(df, *more))
    assert QUERIES["note_knn"](spark, folder).count() == 10
    assert "MapInArrow" not in asked[0]._jdf.queryExecution().executedPlan().toString()


def test_a_batch_is_as_many_files_as_asked(spark, tmp_path):
    """A micro-batch of one file is one task for all that the gate does."""
    import os

    from casetrail.sources import topics
    spark_rows = spark.range(100_000).selectExpr("'logins' AS source", "'raw.logins' AS topic", "0 AS partition", "id AS offset",
                                                 "CAST(id AS STRING) AS key", "'{}' AS value").coalesce(1)
    files = topics.files_for(100_000, spark)
    assert files == min(5, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert topics.files_for(0, spark) == topics.files_for(5, spark) == 1
    for _ in range(2):
        topics.append_envelopes(spark_rows, str(tmp_path / "t"), files)
    assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "t")) == 2 * files


def test_verdicts_are_worked_out_once(spark, folder, monkeypatch):
    import casetrail.plans.checks as checks
    made = []
    real = checks.cut
    monkeypatch.setattr(checks, "cut", lambda df: made.append(df.columns) or real(df))
    df = QUERIES["reconcile_counts"](spark, folder)
    assert ["offset", "model", "verdict"] in made
    assert "parse_json" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_like_entries_are_compared_once(spark, monkeypatch):
    """Entries of one name and birth date meet the openings as one."""
    from casetrail.operators import screen as module
    born = datetime.date(1980, 1, 1)
    opened = spark.createDataFrame([("r1", "sipho dlamini", born), ("r2", "sipho dlamini", None)],
                                   "record_id string, name_norm string, date_of_birth date")
    listed = spark.createDataFrame([(f"S-{i}", "sipho dlamini", ["sipho m dlamini"], born if i % 2 else None) for i in range(10)],
                                   "entry_id string, name_norm string, aliases_norm array<string>, date_of_birth date")
    pairs = []
    real = module.similarity_join
    monkeypatch.setattr(module, "similarity_join", lambda *a, **k: pairs.append(real(*a, **k)) or pairs[-1])
    got = sorted((r["record_id"], r["entry_id"], r["score"]) for r in module.screen(opened, listed).collect())
    assert got == sorted([("r1", f"S-{i}", 1.0) for i in range(10)] + [("r2", f"S-{i}", 1.0) for i in range(0, 10, 2)])
    assert sum(p.count() for p in pairs) <= 4


def test_copies_of_messages_are_made_from_one_reading(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("b", None)], "key string, offset long").write.parquet(str(tmp_path / "sent"))
    sent = spark.read.parquet(str(tmp_path / "sent"))
    both = checks.copied(sent, 100)
    assert both.columns == sent.columns
    assert sorted((r["key"], r["offset"] or 0) for r in both.collect()) == [
        ("a", 1), ("a", 101), ("b", 0), ("b", 0), ("b", 2), ("b", 102)]
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
