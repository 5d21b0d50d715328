"""What a task has in hand at once, and what moves between tasks, in the jaccard join and the pipeline."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from llm import jaccard_join
from llm.bloom import build


class Held:
    def __init__(self, value):
        self.value = value


def test_prefixes_leave_in_small_batches():
    texts = [" ".join(f"w{i}x{j}" for j in range(3000)) for i in range(500)]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    none = Held((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    out = list(jaccard_join._prefixes(3, 90, 100, none)(iter([batch])))
    assert max(b.num_rows for b in out) <= jaccard_join.MOST_TOKENS + 301
    assert sum(b.num_rows for b in out) == 500 * jaccard_join.prefix_length(2998, 90, 100)
    assert len(out) > 1


def test_only_wanted_texts_move(spark):
    held = spark.range(1000).select(F.col("id").alias("node"), F.repeat(F.lit("x"), 100).cast("binary").alias("packed"))
    wanted = spark.sparkContext.broadcast(build(held.filter("node % 50 = 0").select("node"), 20))
    left = {r["node"] for r in held.mapInArrow(jaccard_join._passing(wanted, "node"), held.schema).collect()}
    assert left >= set(range(0, 1000, 50)) and len(left) < 200


def test_pipeline_hands_few_texts_to_python(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
        corpus_pipeline.drop_lines(spark, docs, "")
        assert int(spark.conf.get(name)) == corpus_pipeline.ROWS_IN_HAND
    finally:
        spark.conf.set(name, before)


def test_chunks_end_at_bytes_and_keep_groups_whole():
    names = ["region", "pair", "packed"]
    rows = [pa.record_batch([pa.array([i // 2], pa.int64()), pa.array([0], pa.int64()), pa.array([bytes(100_000)])], names)
            for i in range(200)]
    chunks = list(jaccard_join._chunks(iter(rows), 1000))
    assert max(c.nbytes for c in chunks) <= jaccard_join.CHUNK_BYTES + 200_000
    regions = [set(c["region"].to_pylist()) for c in chunks]
    assert sum(map(len, regions)) == 100 and sum(c.num_rows for c in chunks) == 200


def test_sets_of_several_pieces_equal_those_of_one():
    texts = [f"a{i} b c d{i % 7}" * (i % 5) for i in range(3 * jaccard_join.PIECE + 1)]
    packed = [jaccard_join.zstandard.compress(t.encode()) for t in texts]
    found = jaccard_join.unpacked(packed, 2)
    for x, y in zip(found, jaccard_join.shingle_sets(pa.array(texts), 2), strict=True):
        assert np.array_equal(x, y)


def test_pipeline_bounds_the_bytes_of_a_batch(spark):
    name, rows = (f"spark.sql.execution.arrow.{x}" for x in ("maxBytesPerBatch", "maxRecordsPerBatch"))
    before, rows_before = spark.conf.get(name), spark.conf.get(rows)
    try:
        corpus_pipeline.small_batches(spark)
        assert int(spark.conf.get(name).rstrip("bB")) == corpus_pipeline.BYTES_IN_HAND
        long = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
        sizes = long.mapInArrow(lambda it: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in it), "n long").collect()
        assert max(r["n"] for r in sizes) < 2 * corpus_pipeline.BYTES_IN_HAND
    finally:
        spark.conf.set(name, before)
        spark.conf.set(rows, rows_before)
