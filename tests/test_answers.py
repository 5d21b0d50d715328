"""Money summaries, notes, citations and reconciliation."""

import datetime as dt
import json
from decimal import Decimal
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame

from casetrail.operators import citations, notes, reconcile, summary
from casetrail.sources.store import without_prefix

NOW = dt.datetime(2026, 9, 1)
TXN = ("txn_id string, ts timestamp, from_account string, to_account string, amount_zar decimal(14,2), "
       "channel string, reference string")


def txn(n, src, dst, amount, days_ago=1):
    return (f"T{n:07d}", NOW - dt.timedelta(days=days_ago), src, dst, Decimal(amount), "app", "")


def test_summary(spark):
    rows = [txn(1, "A000002", "A000001", "600.00"), txn(2, "A000003", "A000001", "400.00"),
            txn(3, "A000001", "A000004", "900.00"), txn(4, "A000001", "A000009", "5.00", days_ago=400)]
    out = {r.account_id: r for r in summary.account_summary(
        spark.createDataFrame(rows, TXN), NOW, 365, ["A000001", "A000007"]).collect()}
    row = out["A000001"]
    assert (row.inbound_count, row.inbound_total_zar, row.outbound_count, row.outbound_total_zar) == (2, 1000.0, 1, 900.0)
    assert row.pass_through_ratio == 0.9 and (row.distinct_senders, row.distinct_receivers) == (2, 1)
    assert [(t.account_id, t.direction, t["count"], t.total_zar) for t in row.top_counterparties] == [
        ("A000004", "out", 1, 900.0), ("A000002", "in", 1, 600.0), ("A000003", "in", 1, 400.0)]
    assert row.evidence_ids == ["T0000003", "T0000001", "T0000002"]
    empty = out["A000007"]
    assert empty.pass_through_ratio is None and empty.inbound_total_zar == 0.0 and empty.first_seen is None
    assert empty.top_counterparties == [] and empty.evidence_ids == []
    for bad in ({"days": 0}, {"days": 3651}, {"accounts": ["A1"]}):
        with pytest.raises(ValueError):
            summary.account_summary(spark.createDataFrame(rows, TXN), NOW, **bad)


def same_answers(got, want):
    rows = [sorted((tuple(r) for r in x.collect()), key=str) for x in (got, want)]
    assert rows[0] == rows[1] and rows[1]


@pytest.mark.parametrize(("now", "days"), [(NOW, 31), (NOW, 45), (NOW + dt.timedelta(days=3, hours=5), 400), (NOW, 3650)])
def test_summary_from_state(spark, now, days):
    """Three parts of the transfers, folded apart and merged or not, answer as all transfers do; ties, own accounts, edges."""
    rng = np.random.default_rng(5)
    rows = [(f"T{i:07d}", NOW - dt.timedelta(hours=int(rng.integers(0, 24 * 500))), f"A{rng.integers(1, 7):06d}",
             f"A{rng.integers(1, 7):06d}", Decimal(int(rng.integers(1, 40))), "app", "") for i in range(600)]
    rows += [(f"T{i:07d}", NOW - dt.timedelta(days=d), "A000001", "A000002", Decimal("7.25"), "app", "")
             for i, d in enumerate((31, 45, 62, 400, 3650, 0), 900)]
    txns = spark.createDataFrame(rows, TXN)
    parts = [txns.filter(f"pmod(xxhash64(txn_id), 3) = {k}") for k in range(3)]
    state, largest = (reduce(DataFrame.unionByName, map(fold, parts)) for fold in (summary.monthly, summary.monthly_top))
    want = summary.account_summary(txns, now, days)
    same_answers(summary.stored_summary(state, largest, txns, now, days), want)
    state, largest = summary.merge_monthly(state), summary.merge_monthly_top(largest)
    assert state.count() == state.select("from_account", "to_account", "month").distinct().count()
    same_answers(summary.stored_summary(state, largest, txns, now, days), want)
    some = ["A000001", "A000099"]
    same_answers(summary.stored_summary(state, largest, txns, now, days, some), summary.account_summary(txns, now, days, some))


def dense(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    return [np.array(r.embedding, np.float64) for r in notes.embed(df).orderBy("n").collect()]


def test_hashed_vectors(spark):
    a, b, c, none, null = dense(spark, "many small deposits moved out within hours", "small deposits were moved out within a few hours",
                                "customer asked for a new debit card", "123", None)
    assert len(a) == 768 and abs(a @ a - 1) < 1e-4
    assert a @ b > a @ c
    assert not none.any() and not null.any()


def test_sparse_and_dense_hash_agree(spark):
    texts = ["Many small deposits, many hours", "a bb ccc dddd eeeee", "Ünïcode wörds too " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    sparse = {}
    for r in notes.sparse_hash(df, "n").collect():
        sparse.setdefault(r.n, {})[r.bucket] = r.value
    for n, vector in enumerate(dense(spark, *texts)):
        length = np.sqrt(sum(v * v for v in sparse[n].values()))
        assert set(np.flatnonzero(vector)) <= set(sparse[n])
        assert all(abs(vector[b] - v / length) < 1e-6 for b, v in sparse[n].items())


def test_note_search_and_pending(spark):
    rows = [("N-00001", "A000001", "x", NOW, "small deposits were moved out within hours"),
            ("N-00002", "A000002", "x", NOW, "customer asked for a new debit card"),
            ("N-00003", "A000002", "x", NOW, "small deposits were moved out within hours")]
    table = spark.createDataFrame(rows, "note_id string, account_id string, author string, created_at timestamp, text string")
    stored = notes.embed(table.filter("note_id = 'N-00001'")).select("note_id", "embedding")
    assert sorted(r.note_id for r in notes.embed_pending(table, stored).collect()) == ["N-00002", "N-00003"]
    vectors = notes.embed(table)
    near = notes.search_notes(vectors, "deposits moved within hours", 2).orderBy("rank").collect()
    assert [r.note_id for r in near] == ["N-00001", "N-00003"] and near[0].distance == near[1].distance
    only = notes.search_notes(vectors, "deposits moved within hours", 5, "A000002").orderBy("rank").collect()
    assert [r.note_id for r in only] == ["N-00003", "N-00002"]
    own = notes.embed(table, lambda texts, kind: [[float(len(t)), 1.0] for t in texts])
    assert len(own.first().embedding) == 2
    for bad in (("ab", 5, None), ("abc", 21, None), ("abc", 5, "A1")):
        with pytest.raises(ValueError):
            notes.search_notes(vectors, *bad)


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 8)).astype(np.float32)
    asked = [("a", rows[3].tolist()), ("b", rng.normal(size=8).tolist())]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(rows)], "n bigint, embedding array<float>").repartition(5)
    got = {(r.query, r["rank"]): r.n for r in notes.nearest(
        df, spark.createDataFrame(asked, "query string, vector array<double>"), 7, "n").collect()}
    for name, q in asked:
        q = np.array(q)
        away = 1 - rows.astype(float) @ q / np.linalg.norm(rows.astype(float), axis=1) / np.linalg.norm(q)
        assert [got[(name, k + 1)] for k in range(7)] == np.argsort(away, kind="stable")[:7].tolist()


def test_citations(spark):
    rows = [("r1", 1, "human", "who shares a device?", 0, 0, 0),
            ("r1", 2, "ai", "", 2, 10, 3),
            ("r1", 3, "tool", '{"evidence_ids":["L0000001"]}', 0, 0, 0),
            ("r1", 4, "tool", '{"evidence_ids":["T0000145"]}', 0, 0, 0),
            ("r1", 5, "ai", "shares [L0000001], forwards [T0000145], and [T9999999].\nAccounts: A005386, A005382", 0, 7, 9),
            ("r2", 1, "ai", "A005386 is definitely a mule [T0000145].", 0, 1, 1)]
    table = spark.createDataFrame(rows, "run_id string, seq int, role string, content string, tool_calls int, "
                                        "input_tokens int, output_tokens int")
    out = {r.run_id: r for r in citations.audit(table).collect()}
    assert out["r1"].verified_evidence == ["L0000001", "T0000145"] and out["r1"].unverified_evidence == ["T9999999"]
    assert out["r1"].accounts_mentioned == ["A005382", "A005386"]
    assert (out["r1"].tool_calls, out["r1"].input_tokens, out["r1"].output_tokens) == (2, 17, 12)
    assert out["r2"].unverified_evidence == ["T0000145"] and out["r2"].tool_calls == 0
    assert out["r1"].status == "PENDING ANALYST REVIEW"


def test_reconcile(spark, tmp_path):
    truth = {"published_counts": {"kyc": 4, "transactions": 10, "logins": 0, "sanctions": 1, "case_notes": 0},
             "bad_records": {"transactions": [{"id": "T1", "damage": "x"}, {"id": "T2", "damage": "y"}]},
             "duplicate_txn_ids": ["T3"], "expected_accounts": 4, "expected_persons": 2,
             "controller_accounts": ["A000001"], "sanctions_hit": {"entry_id": "S-083"}}
    path = tmp_path / "truth.json"
    path.write_text(json.dumps(truth))
    read = reconcile.read_truth(spark, str(path))
    assert {r.source: r.expected for r in reconcile.expected_counts(read).collect()}["transactions"] == 7

    expected = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "-"), ("d", "4")], "name string, value string")
    actual = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "9")], "name string, value string")
    got = {r.name: r["pass"] for r in reconcile.reconcile(expected, actual).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}

    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "w")], "k int, v string")
    rows = reconcile.reconcile_rows(left, right, ["k"], ["v"]).collect()
    assert sorted(map(tuple, rows)) == [(2, "different"), (4, "missing_left")]


def test_small_sinks(spark):
    drill = spark.createDataFrame([("T9000001",), ("T0000001",)], "txn_id string")
    assert [r[0] for r in without_prefix(drill).collect()] == ["T0000001"]
    letters = spark.createDataFrame([("rejected", "kyc", "1"), ("rejected", "kyc", "1"), ("poison", "kyc", None)],
                                    "kind string, source string, key string")
    assert {r.kind: r.n for r in reconcile.distinct_dead_letters(letters).collect()} == {"rejected": 1, "poison": 1}
    done = spark.createDataFrame([("kyc", "applied"), ("kyc", "poison"), ("logins", "applied")], "source string, outcome string")
    got = {r.source: (r.applied, r.duplicate, r.rejected, r.poison) for r in reconcile.outcome_counts(done).collect()}
    assert got == {"kyc": (1, 0, 0, 1), "logins": (1, 0, 0, 0)}
