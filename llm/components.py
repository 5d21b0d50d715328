"""Connected components by alternating large-star and small-star joins (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import written


def _star(pairs: DataFrame, name: str) -> DataFrame:
    """(u, v) with neighbours v of u: every v is tied to the least of u and its neighbours."""
    least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it) for every node of edges (a, b) of ids that compare.

    The number of rounds grows with the logarithm of the longest path; each round is two joins on written tables.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                    "edges")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "large")
        tied = _star(large, "small")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            tied.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = written(small, "small")
        if small.count() == edges.count() and small.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges = small
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
