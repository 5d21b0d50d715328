"""The inverted file of vectors against all distances."""

import numpy as np
import pytest

from casetrail.operators.notes import nearest
from casetrail.operators.vector_index import build_index, search_index


def tables(spark, clustered, size=24):
    r = np.random.default_rng(5)
    if clustered:
        middles = r.normal(size=(40, size))
        rows = [middles[n % 40] + 0.08 * r.normal(size=size) for n in range(1200)]
        asked = [middles[n] + 0.08 * r.normal(size=size) for n in range(12)]
    else:
        rows, asked = list(r.normal(size=(400, size))), list(r.normal(size=(6, size)))
    rows += [rows[0]] * 5 + [np.zeros(size), np.zeros(size), -rows[1], rows[2] * 50]
    asked += [rows[0], rows[2] / 7]
    vectors = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(rows)] + [(-1, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(f"q{n}", v.tolist()) for n, v in enumerate(asked)], "query string, vector array<double>")
    return vectors.repartition(3), queries, len(asked)


def hits(df):
    return sorted((r.query, r.id, round(r.distance, 8) if r.distance == r.distance else None, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("clustered", [True, False])
def test_exact(spark, clustered):
    vectors, queries, n = tables(spark, clustered)
    index, visited = build_index(vectors, "id", cells=30), []
    got = hits(search_index(index, queries, 7, visited=visited))
    assert got == hits(nearest(vectors.filter("embedding IS NOT NULL"), queries, 7, "id"))
    read = visited[0].count()
    assert read <= n * 31
    if clustered:
        assert read <= 0.35 * n * 31       # most cells fall to the bound
    assert index.sizes.sum() == index.rows.count()


def test_probes_and_recall(spark):
    vectors, queries, n = tables(spark, True)
    index, visited = build_index(vectors, "id"), []
    want = hits(nearest(vectors.filter("embedding IS NOT NULL"), queries, 10, "id"))
    got = hits(search_index(index, queries, 10, probes=4, visited=visited))
    assert visited[0].count() == 4 * n
    found = {h[:2] for h in got} & {h[:2] for h in want}
    assert len(found) >= 0.9 * len(want)


def test_small_tables(spark):
    shape = "id long, embedding array<double>"
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query string, vector array<double>")
    assert search_index(build_index(spark.createDataFrame([], shape), "id"), queries, 3).collect() == []
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 2.0]), (3, [5.0, 0.0])], shape)
    got = search_index(build_index(few, "id"), queries, 5).collect()
    assert [(r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 1), (2, 2), (1, 3)]
    with pytest.raises(ValueError):
        search_index(build_index(few, "id"), queries, 0)
