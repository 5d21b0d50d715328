"""Top-k against brute force, the classifier on held-out rows, the pipeline's stages, the registered SQL."""

import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import topk, toxicity
from llm.queries import ORACLE, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("scale", [1024, 2 ** 40])
def test_top_k(spark, scale):
    r = np.random.default_rng(3)
    vectors = {i: r.normal(size=8).tolist() for i in range(150)}
    vectors.update({200 + i: vectors[0] for i in range(20)})  # ties
    data = [(i, v) for i, v in vectors.items()] + [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8),
                                                   (303, [float("inf")] * 8), (304, [2.0] * 3), (None, [1.0] * 8), (100, [])]
    rows = topk.quantised(spark.createDataFrame(data, "key long, v array<double>"), "key", "v", scale)
    got = topk.top_k(rows.filter("key % 50 = 0"), rows, 5, levels=(2, 4), query_block=2, row_block=40).collect()
    whole = {i: [int(np.floor(scale * x)) for x in v] for i, v in vectors.items()}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q)[:5]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    if scale == 1024:
        assert {tuple(x) for x in got} == want
    else:
        assert len(got) == len(want) and all(abs(x.score) < 2 ** 63 for x in got)


def test_top_k_of_nothing(spark):
    rows = topk.quantised(spark.createDataFrame([], "key long, v array<float>"), "key", "v", 1024)
    assert topk.top_k(rows, rows, 3).collect() == []


def made_up(spark, n=600):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        w = [("or", "en")[i % 2] + "".join(r.choice("tnslr") for _ in range(4)) for _ in range(r.randrange(20, 80))]
        toxic = r.random() < 0.25
        for _ in range(3 * toxic):
            w[r.randrange(len(w))] = ("vilest", "grobian")[i % 2] + "".join(r.choice("xy") for _ in range(2))
        docs.append((i, " ".join(w), lang))
        labels.append((i, int(toxic)))
    docs += [(n, None, None), (n + 1, "", "aa"), (n + 2, "word " * 30_000, None), (0, docs[0][1], "aa")]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3),
            spark.createDataFrame([*labels, (n + 5, None), (None, 1)], "doc_id long, toxic int"))


def test_held_out_accuracy(spark):
    docs, labels = made_up(spark)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if i in got and zlib.crc32(str(i).encode()) % 4 == 2 and truth[i] is not None]
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 603
    right = sum((got[i] >= toxicity.DECISION) == bool(truth[i]) for i in held)
    assert right >= 0.95 * len(held)
    assert got[600] == got[601] < toxicity.DECISION


def test_long_texts_do_not_end_the_sample(spark):
    docs, labels = made_up(spark, 200)
    learnt = toxicity.labelled(labels).withColumn("rank", F.xxhash64(F.lit(11), F.col("doc_id")))
    first = learnt.orderBy("rank").first()
    long = docs.filter(F.col("doc_id") != first.doc_id).unionAll(
        spark.createDataFrame([(first.doc_id, "word " * 50_000, "aa")], docs.schema))
    sample = toxicity.training_rows(long, labels, words=60_000).collect()
    whole = {r["rank"] for r in learnt.collect()}
    # Rows without a label only teach the languages.
    assert {r["rank"] for r in sample if r["toxic"] is not None} == whole - {first["rank"]}
    assert {r.score for r in toxicity.toxicity(long, labels, words=60_000).collect()} != {0.0}
    only = docs.join(learnt.select("doc_id", "toxic"), "doc_id").withColumn(
        "text", F.when(F.col("toxic") == 1, F.repeat(F.lit("word "), 50_000)).otherwise(F.col("text"))).drop("toxic")
    with pytest.raises(ValueError, match="only one"):
        toxicity.toxicity(only, labels, words=60_000)


def test_thresholds_come_from_all_labels(spark):
    docs, labels = made_up(spark, 400)
    many = docs.withColumns({
        "lang": F.when(F.col("doc_id").between(0, 39), F.concat(F.lit("l"), F.col("doc_id") % 20)).otherwise(F.col("lang")),
        "text": F.when(F.col("doc_id").between(0, 39), F.repeat(F.concat(F.lit("own"), F.col("doc_id") % 20, F.lit(" ")), 30))
        .otherwise(F.col("text"))})
    rows = toxicity.training_rows(many, labels, toxic=15, clean=15).collect()
    assert sorted(r["toxic"] for r in rows if r["toxic"] is not None) == [0] * 15 + [1] * 15
    models = toxicity.fit(sorted(rows, key=lambda r: (r["rank"], r["ids"])))
    spoken = {r["lang"] for r in many.filter(~toxicity.held_out(F.col("doc_id"))).collect() if r["lang"]}
    assert set(models[0].languages) == spoken and len(spoken) > 16
    counts = toxicity.unseen_counts(many, labels, models).collect()
    assert sum(r["n"] for r in counts) == many.join(toxicity.labelled(labels), "doc_id").count()
    toxicity.calibrate(models[0], counts)
    big = [models[0].languages.index(x) for x in ("aa", "bb")]
    for k in big:  # fewer than 20 rows of a kind in the sample, more in the table
        cells = {}
        for r in counts:
            if r["language"] == k:
                cells.setdefault(r["cell"], [0, 0])[r["toxic"]] += r["n"]
        assert models[0].thresholds[k] == pytest.approx(toxicity.best_threshold(cells))


def test_best_threshold():
    assert toxicity.best_threshold({64: [0, 5], 0: [9, 0]}) == (64 + 1) / 2 / 64
    assert toxicity.best_threshold({64: [0, 5]}) == 0


def test_scores_ignore_columns(spark):
    docs, labels = made_up(spark, 200)
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, toxic=20, clean=60).collect()}
    extra = docs.withColumn("score", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("ids", F.lit(3))
    b = {r.doc_id: r.score for r in toxicity.toxicity(extra, labels, toxic=20, clean=60).collect()}
    assert a == b


def test_no_labels(spark):
    docs, labels = made_up(spark, 10)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.withColumns({"slot": F.lit(1), "score": F.lit(2)})
    texts = {r.doc_id: r.text for r in docs.collect()}
    before = texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(before) and len(now) == docs.count()
        if name == "mixing":
            assert now == before
        elif name != "line_dedup":
            assert all(before[i] == t for i, t in now.items())
        before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(before)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_no_rows(spark, empty, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, empty, SMALL).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_registered_sql(spark, name):
    good, note = compare(spark, connect(SMALL), SMALL, name, QUERIES[name], ORACLE[name])
    assert good, note
