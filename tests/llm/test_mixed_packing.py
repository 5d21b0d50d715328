"""The order of the mix reaches the packed sequences."""

import corpus_pipeline
from llm import packing
from llm.common import written
from llm.queries import tokenizer_files


def test_sequences_follow_the_order(spark):
    rows = [(100 - i, "word " * (1 + i % 7 * 40), i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long")
    got = packing.pack(docs, *tokenizer_files(), group=10, order="place").collect()
    place = {doc: p for doc, _, p in rows}
    assert {r["doc_id"] for r in got} == set(place)
    for r in got:
        assert r["sequence_id"] >> 32 == place[r["doc_id"]] // 10
    first = {}
    for r in got:
        s = r["sequence_id"]
        first[s] = min(first.get(s, 99), place[r["doc_id"]])
    assert [first[s] for s in sorted(first)] == sorted(first.values())


def test_a_written_order_is_read_again(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "(id * 7919) % 1000 AS at").repartition(3).orderBy("at")
    got = corpus_pipeline.placed(written(docs, "order")).collect()
    assert sorted(r["place"] for r in got) == list(range(1000))
    assert all(r["place"] == r["at"] for r in got)
    assert "place" not in docs.columns


def test_the_last_stage_packs_in_the_order_written(spark, monkeypatch):
    seen = []
    real = packing.pack
    monkeypatch.setattr(packing, "pack", lambda docs, *a, **k: seen.append((docs, k)) or real(docs, *a, **k))
    rows = spark.createDataFrame([(i, "x", "en", "s", (i * 37) % 50) for i in range(50)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, written(rows.orderBy("n_chars"), "mixed"), "unused").count() == 50
    docs, how = seen[0]
    assert how == {"order": "place"} and all(r["place"] == r["n_chars"] for r in docs.collect())
    assert pack(spark, rows, "unused").count() == 50 and seen[1][1] == {}
