"""Nearest vectors through an inverted file: vectors lie in the cell of their nearest centre, a question reads few cells.

Centres are fitted by spherical k-means on a bounded sample (SAMPLE rows by a hash of the key); every row is indexed. A
cell knows its radius, the largest angle between its centre and a vector in it. No vector of a cell can be nearer to a
question than angle(question, centre) - radius, so a search first reads the cells with the least bound, has a
k-th best distance then, and reads on only in cells whose bound does not exceed it: the result is exact. With `probes` only so many cells
are read, and recall is what the test measures. Vectors without direction (zero) are in a cell of their own that is read last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetrail.operators.notes import QUERY_BLOCK, VECTOR_BLOCK, closest
from casetrail.session import cut

SAMPLE, MOST_CELLS, ROUNDS, FIRST = 8192, 1024, 8, 2
EDGE = 1e-6     # distances are rounded to nine decimals, angles near 0 lose half of them


@dataclass
class VectorIndex:
    """rows: key, row (array<double>) and cell; one centre, radius and size for each cell. The last cell is that of zero vectors."""

    rows: DataFrame
    key: str
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _units(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1))[:, None]
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fit_centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres; a centre that loses all its vectors keeps its place."""
    rng = np.random.default_rng(seed)
    units = np.unique(_units(sample), axis=0)
    units = units[(units != 0).any(axis=1)]
    if not len(units):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    centres = units[rng.permutation(len(units))[:cells]]
    for _ in range(ROUNDS):
        nearest = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        moved = _units(sums)
        centres = np.where((moved != 0).any(axis=1)[:, None], moved, centres)
    return centres


def _assign(centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = centres.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            units = _units(rows)
            near = units @ middle.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            zero = ~(units != 0).any(axis=1)
            cell[zero], angle[zero] = len(middle), np.pi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)],
                                             [*batch.schema.names, "cell", "angle"])
    return run


def build_index(vectors: DataFrame, key: str, embedding: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Index all rows of `vectors` that have a vector (all of one length, without nulls)."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(embedding).isNotNull()).select(key, F.col(embedding).cast("array<double>").alias("row"))
    total = rows.count()
    sample = rows.orderBy(F.xxhash64(F.col(key))).limit(SAMPLE).select("row").toArrow().column("row").combine_chunks()
    values = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1) if len(sample) else np.zeros((0, 1))
    centres = fit_centres(values, cells or int(np.clip(np.sqrt(total), 1, MOST_CELLS)))
    shared = spark.sparkContext.broadcast(centres)
    kind = vectors.schema[key].dataType.simpleString()
    placed = cut(rows.mapInArrow(_assign(shared), f"`{key}` {kind}, row array<double>, cell int, angle double"))
    shared.destroy()
    radii, sizes = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
    # One row for each cell, MOST_CELLS at most.
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        radii[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
    return VectorIndex(placed.select(key, "row", "cell"), key, centres, radii, sizes)


def _bounds(index: VectorIndex, shared):
    """(query, vector, cell, bound, place) for every cell that holds something, least bound first."""
    radii, sizes = index.radii, index.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(sizes > 0)
        for batch in batches:
            for at in range(batch.num_rows):
                vector = np.asarray(batch.column("vector")[at].as_py(), np.float64)
                unit = _units(vector[None, :])[0]
                angle = np.arccos(np.clip(shared.value @ unit, -1, 1)) if unit.any() else np.zeros(len(shared.value))
                bound = np.maximum(np.append(angle, 2 * np.pi) - radii, 0)[used]
                order = np.argsort(bound, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query").take(pa.array([at] * len(used))), pa.array(used[order].astype(np.int32)),
                     pa.array(bound[order]), pa.array(np.arange(len(used), dtype=np.int32))], ["query", "cell", "bound", "place"])
    return run


def _read_cells(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """query, key and distance of the k best of each visited cell; `asked` has query, vector and cell.

    Large cells are dealt into parts and questions into blocks, so no task holds more than a block of either.
    """
    kind = index.rows.schema[index.key].dataType.simpleString()
    parts = index.rows.sparkSession.createDataFrame(
        [(c, max(1, -(-int(n) // VECTOR_BLOCK))) for c, n in enumerate(index.sizes)], "cell int, parts int")
    wanted = asked.groupBy("cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / QUERY_BLOCK).cast("int"))
    # One row for each cell, MOST_CELLS at most.
    wanted = F.broadcast(cut(wanted.join(F.broadcast(parts), "cell").drop("n")))
    questions = asked.join(wanted, "cell").select(
        "cell", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query", "vector")
    rows = index.rows.join(wanted, "cell").select(
        F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"),
        F.pmod(F.xxhash64(index.key), F.col("parts")).cast("int").alias("p"), F.col(index.key).alias("key"), "row")
    key = index.key

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        named = [(r["query"], np.asarray(r["vector"], dtype=np.float64)) for r in left.to_pylist()]
        found: tuple[list, list, list] = ([], [], [])
        for batch in right.select(["key", "row"]).to_batches():
            for have, more in zip(found, closest(batch, named, k), strict=True):
                have.extend(more)
        return pa.table({"query": pa.array(found[0], pa.string()), key: pa.array(found[1], right.schema.field("key").type),
                         "distance": pa.array(found[2], pa.float64())})

    return questions.groupBy("cell", "block", "part").cogroup(rows.groupBy("c", "b", "p")).applyInArrow(
        compare, f"query string, `{key}` {kind}, distance double")


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None,
                 visited: list[DataFrame] | None = None) -> DataFrame:
    """(query, key, distance, rank) of the k rows closest to each query; exact unless `probes` limits the cells.

    `queries` has `query` (string, distinct) and `vector`. Ties go to the smaller key. `visited` collects the visited (query, cell)s.
    """
    if k < 1 or (probes is not None and probes < 1):
        raise ValueError("k and probes must be positive")
    if not index.sizes.any():
        kind = index.rows.schema[index.key].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query string, `{index.key}` {kind}, distance double, rank int")
    queries = cut(queries.select("query", F.col("vector").cast("array<double>").alias("vector")))
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)
    cells = cut(queries.mapInArrow(_bounds(index, shared), "query string, cell int, bound double, place int"))
    shared.destroy()
    now = cells.filter(F.col("place") < (probes or FIRST))
    found = cut(_read_cells(index, now.join(queries, "query"), k))
    seen = [now]
    if probes is None:
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance"))
        kth = (found.filter(~F.isnan("distance")).withColumn("rank", rank).filter(F.col("rank") <= k).filter(F.col("rank") == k)
               .select("query", F.acos(F.greatest(1 - F.col("distance"), F.lit(-1.0))).alias("angle")))
        rest = cells.filter(F.col("place") >= FIRST).join(kth, "query", "left").filter(
            F.col("angle").isNull() | (F.col("bound") <= F.col("angle") + (2 * EDGE) ** 0.5)).drop("angle")
        rest = cut(rest)
        found = found.unionByName(_read_cells(index, rest.join(queries, "query"), k))
        seen.append(rest)
    if visited is not None:
        visited.append(seen[0] if len(seen) == 1 else seen[0].unionByName(seen[1].select(*seen[0].columns)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", index.key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
