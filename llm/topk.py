"""Exact top-k by inner product, pruned with segment means and deviations from coarse to fine.

A vector cut into segments of n components has in each a mean m and a deviation s (root of the mean
squared difference). For a query q and a candidate c the squared distance is at least
sum n * ((mq - mc)**2 + (sq - sc)**2), so the inner product is at most sum n * (mq * mc + sq * sc): a
dot product of the statistics. A pair is dropped as soon as this bound is below the query's k-th
best exact score so far; the bound is worked out with few segments first, then with more for what is
left, and survivors get exact integer scores.

Queries are a stated set and are compared with all rows in blocks: queries and candidates
are numbered into blocks of bounded size, and each task gets one block of either. Only each block's k best
move on. Vectors that are null or hold null or non-finite components take no part, nor do vectors
of another length than the query's. Ties go to the smaller id. Rows without id take no part; rows of
one id are candidates of their own, and an id never answers itself. Scores beyond 64 bits are given as the limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (4, 16)
QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """key and `v`, the components as floor(scale * x) in long, for rows that take part."""
    v = F.col(vector)
    fit = v.isNotNull() & F.col(key).isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return df.filter(F.coalesce(fit, F.lit(False))).select(F.col(key).alias("key"), whole.alias("v"))


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, each times the root of the segment's length."""
    out = []
    for part in np.array_split(vectors, min(segments, vectors.shape[1]), axis=1):
        root = np.sqrt(part.shape[1])
        out += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(out, axis=1)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, row by row; in floats only where these are exact."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[-1], 1)
    if largest < 2 ** 53:
        return np.einsum("ij,ij->i", q.astype(np.float64), c.astype(np.float64)).astype(np.int64)
    if largest < 2 ** 63:
        return (q * c).sum(axis=1)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True)], object)


def block_best(q_ids, q, c_ids, c, k: int, levels=LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of a block for each query of a block: query row, candidate row, score."""
    if not q.shape[1]:
        a, b = np.meshgrid(np.arange(len(q)), np.arange(len(c)), indexing="ij")
        rows, cols = a.ravel(), b.ravel()
        ok = q_ids[rows] != c_ids[cols]
        return _first(rows[ok], cols[ok], np.zeros(int(ok.sum()), np.int64), c_ids, k)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    slack = 1e-9 * np.linalg.norm(qf, axis=1)[:, None] * np.linalg.norm(cf, axis=1).max() + 1
    bound = statistics(qf, levels[0]) @ statistics(cf, levels[0]).T + slack
    same = np.nonzero(q_ids[:, None] == c_ids[None, :])
    bound[same] = -np.inf
    # The k candidates with the best bounds give a first k-th best score that truly occurs.
    few = min(k + 1, len(c))
    rows = np.repeat(np.arange(len(q)), few)
    cols = np.argpartition(-bound, few - 1, axis=1)[:, :few].ravel()
    first = exact_scores(q[rows], c[cols]).astype(np.float64)
    first = np.where(q_ids[rows] != c_ids[cols], first, -np.inf).reshape(len(q), few)
    least = (np.sort(first, axis=1)[:, -k] if few >= k else np.full(len(q), -np.inf))[:, None] - 1
    open_ = (bound >= least) & (bound > -np.inf)
    left = np.arange(len(c))
    for level in levels[1:]:
        some = open_.any(axis=0)
        left, open_ = left[some], open_[:, some]
        open_ &= statistics(qf, level) @ statistics(cf[left], level).T + slack >= least
    some = open_.any(axis=0)
    left, open_ = left[some], open_[:, some]
    if float(np.abs(qf).max()) * float(np.abs(cf).max()) * q.shape[1] < 2 ** 53:
        scores = np.where(open_, qf @ cf[left].T, -np.inf)  # whole numbers, exact in floats
        if scores.shape[1] > k:
            open_ &= scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        rows, cols = np.nonzero(open_)
        return _first(rows, left[cols], scores[rows, cols].astype(np.int64), c_ids, k)
    rows, cols = np.nonzero(open_)
    return _first(rows, left[cols], exact_scores(q[rows], c[left[cols]]), c_ids, k)


def _first(rows, cols, scores, c_ids, k: int):
    order = np.lexsort((c_ids[cols], -scores.astype(np.float64) if scores.dtype == object else -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    start = np.searchsorted(rows, rows, side="left")
    best = np.arange(len(rows)) - start < k
    return rows[best], cols[best], scores[best]


def _compare(k: int, levels):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "key": [], "score": []}
        if len(queries) and len(rows):
            q_ids, c_ids = queries["key"].to_numpy(), rows["key"].to_numpy()
            a, b, s = block_best(q_ids, np.stack(queries["v"]), c_ids, np.stack(rows["v"]), k, levels)
            whole = [min(max(x, -2 ** 63), 2 ** 63 - 1) for x in s] if s.dtype == object else s
            out = {"query_id": q_ids[a], "key": c_ids[b], "score": np.array(whole, np.int64)}
        return pd.DataFrame(out)
    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int, levels=LEVELS, query_block: int = QUERY_BLOCK,
          row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, key, score; both inputs have `key` and `v` (see `quantised`)."""
    n_queries, n_rows = queries.count(), rows.count()
    q_blocks, r_blocks = max(1, -(-n_queries // query_block)), max(1, -(-n_rows // row_block))
    row = F.monotonically_increasing_id()
    size = F.size("v").alias("size")
    # The block of a row is fixed before its copies are made. Own names on either side: both may come from one table.
    every_r = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))).alias("q_rows")
    every_q = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("r_queries")
    q = queries.select("key", "v", size, F.pmod(F.xxhash64("key", row), F.lit(q_blocks)).alias("q_block"))
    q = q.toDF("key", "v", "q_size", "q_block").select("*", every_r)
    r = rows.select("key", "v", size, F.pmod(F.xxhash64("key", row), F.lit(r_blocks)).alias("r_block"))
    r = r.toDF("key", "v", "r_size", "r_block").select("*", every_q)
    best = q.groupBy("q_size", "q_block", "q_rows").cogroup(r.groupBy("r_size", "r_queries", "r_block")).applyInPandas(
        _compare(k, levels), "query_id long, key long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "key", "score")
