"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order of nearness: vectors that point the same way
see the same pivots first. The index is a set of inverted lists keyed by sets of pivots; a vector stands in the lists
of all `shared`-subsets of its first `prefix` pivots, so two vectors meet exactly if they share at least that many
(Chavez, Figueroa, Navarro, PAMI 2008; Amato, Gennaro, Savino, MTAP 2014). What meets is verified by cosine in double
precision: links are exact, only their retrieval is not complete. Recall is measured in the tests.

* Pivots come from a bounded sample of distinct vectors (SAMPLE), taken so that no two are nearer than `threshold` - 0.1:
  otherwise a crowd of near copies would get many pivots of its own whose order is chance. Random directions fill up.
  Their number grows with the cube root of the rows, at most MOST_PIVOTS, which keeps lists short; prefixes grow with it.
* Equal vectors are one node with a weight from the start, however many there are.
* A pair that shares more pivots meets in several lists and counts in one, that of its smallest shared pivots.
* Lists are first compared by pivots and by the signs of 64 fixed projections; only vectors that share enough pivots with
  another one in the list in which they count, and differ in no more signs than linked vectors do, are moved. The number
  of differing signs is binomial, and the bound lies five deviations above its mean at the threshold (one link in a million is
  lost at the threshold, fewer above it). Long lists are cut into blocks and compared block by block, whole.
* Of a block, only links that connect something new there go on to the components, and counts, not pairs.

Vectors that are null, empty or zero or hold null or non-finite components link with nothing, as do rows without vec_id
(component null, kept). Vectors of unequal length are not linked. Repeated rows are vectors of their own. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import written
from llm.components import components

SAMPLE, MOST_PIVOTS, LEAST_PIVOTS = 8192, 4096, 256
SHARED, BLOCK = 3, 1024
SLACK = 0.1


def unit_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vector; rows that take no part are missing."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    where = np.asarray(column.offsets, np.int64)[:-1]
    values = np.asarray(column.values.fill_null(float("nan")), np.float64)
    valid = np.asarray(column.is_valid())
    out = []
    for size in np.unique(sizes[valid & (sizes > 0)]).tolist():
        rows = np.flatnonzero(valid & (sizes == size))
        v = values[where[rows][:, None] + np.arange(size)]
        largest = np.abs(v).max(axis=1)
        fit = np.isfinite(v).all(axis=1) & (largest > 0)
        rows, v = rows[fit], v[fit] / largest[fit][:, None]
        out.append((rows, v / np.linalg.norm(v, axis=1)[:, None]))
    return out


def pivot_number(rows: int) -> int:
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 24 * rows ** (1 / 3))))


def prefix_length(pivots: int) -> int:
    return max(8, pivots.bit_length() - 1)


def choose_pivots(sample: np.ndarray, number: int, nearest: float, seed: int = 13) -> np.ndarray:
    """Unit vectors, no two of the sampled ones nearer than `nearest`; random directions up to LEAST_PIVOTS."""
    size = sample.shape[1]
    chosen = np.zeros((number, size))
    count = 0
    for v in sample:
        if count == number:
            break
        if not count or (chosen[:count] @ v).max() < nearest:
            chosen[count] = v
            count += 1
    few = max(0, min(number, LEAST_PIVOTS) - count)
    more = np.random.default_rng(seed).normal(size=(few, size))
    return np.concatenate([chosen[:count], more / np.linalg.norm(more, axis=1)[:, None]])


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The first pivots of each vector, nearest first, ties by number. Pivots are cut or padded to the vectors' length."""
    size = vectors.shape[1]
    if pivots.shape[1] != size:
        fitted = np.zeros((len(pivots), size))
        common = min(size, pivots.shape[1])
        fitted[:, :common] = pivots[:, :common]
        pivots = fitted
    near = vectors @ pivots.T
    prefix = min(prefix, len(pivots))
    some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    some.sort(axis=1)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def signs(vectors: np.ndarray) -> np.ndarray:
    """Signs of 64 projections on fixed random directions, as bits of one number."""
    planes = np.random.default_rng(64).normal(size=(vectors.shape[1], 64))
    return np.packbits(vectors @ planes > 0, axis=1).view(np.int64).ravel()


def most_signs(threshold: float) -> int:
    """Signs in which vectors of this cosine differ at most, but for chances beyond five deviations."""
    share = np.arccos(threshold) / np.pi
    return int(np.ceil(64 * share + 5 * np.sqrt(64 * share * (1 - share))))


def _describe(pivots, prefix: int):
    """vec_id, node (a digest of the vector), its first pivots and its signs; all null if it takes no part."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes: list = [None] * batch.num_rows
            first: list = [None] * batch.num_rows
            bits: list = [None] * batch.num_rows
            named = np.asarray(batch.column("vec_id").is_valid())
            for rows, units in unit_vectors(batch.column("vector")):
                if not len(rows):
                    continue
                raw = batch.column("vector").take(pa.array(rows)).flatten()
                raw = np.asarray(raw).reshape(len(rows), -1) + 0.0
                for begin in range(0, len(rows), 2048):
                    near = nearest_pivots(units[begin:begin + 2048], pivots.value, prefix)
                    sides = signs(units[begin:begin + 2048]).tolist()
                    for at, row in enumerate(rows[begin:begin + 2048].tolist()):
                        if named[row]:
                            nodes[row] = hashlib.sha256(raw[begin + at].tobytes()).digest()[:16]
                            first[row] = near[at]
                            bits[row] = sides[at]
            yield pa.record_batch([batch.column("vec_id"), pa.array(nodes, pa.binary()), pa.array(first, pa.list_(pa.int32())),
                                   pa.array(bits, pa.int64()), batch.column("vector")], ["vec_id", "node", "pivots", "signs", "vector"])
    return run


def _postings(shared: int):
    """Lists of a node: every sorted set of `shared` of its pivots, as digest key, with the largest pivot in it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = batch.column("pivots").to_pylist()
            for begin in range(0, batch.num_rows, 1024):
                some = np.sort(np.array(tops[begin:begin + 1024], np.int64), axis=1)
                if not len(some):
                    continue
                sets = np.array(list(itertools.combinations(range(some.shape[1]), min(shared, some.shape[1]))))
                picked = some[:, sets]
                key = np.zeros(picked.shape[:2], np.int64)
                for place in range(picked.shape[2]):
                    key = key * (MOST_PIVOTS + 1) + picked[:, :, place] + 1
                rows = np.repeat(np.arange(begin, begin + len(some)), len(sets))
                yield pa.record_batch([pa.array(key.ravel()), batch.column("size").take(pa.array(rows)),
                                       batch.column("node").take(pa.array(rows))], ["key", "size", "node"])
    return run


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (equal key, size and pair, rows sorted by them), with the number of each row's group."""
    rest: pa.Table | None = None

    def numbered(table: pa.Table) -> np.ndarray:
        keys = np.stack([np.asarray(table.column(c), np.int64) for c in ("key", "size", "pair")], axis=1)
        return np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        group = numbered(table)
        whole = int(np.searchsorted(group, group[-1]))
        rest = table.slice(whole)
        if whole:
            yield table.slice(0, whole), group[:whole]
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(rest.num_rows, np.int64)


def _meetings(table: pa.Table, group: np.ndarray, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that share enough pivots and count in this list: its pivots are the smallest they share."""
    tops = np.stack(table.column("pivots").to_numpy()).astype(np.int32)
    side = np.asarray(table.column("side"))
    largest = (np.asarray(table.column("key"), np.int64) % (MOST_PIVOTS + 1) - 1).astype(np.int32)
    need = min(shared, tops.shape[1])
    for step in range(1, len(group)):
        rows = np.flatnonzero(group[step:] == group[:-step])
        if not len(rows):
            return
        # Blocks of a cut list: within one block all pairs, between two only those across.
        rows = rows[(side[rows] < 0) | (side[rows] != side[rows + step])]
        for begin in range(0, len(rows), 1 << 15):
            a = rows[begin:begin + (1 << 15)]
            same = (tops[a][:, :, None] == tops[a + step][:, None, :]).any(axis=2)
            counted = a[(same & (tops[a] <= largest[a][:, None])).sum(axis=1) == need]
            if len(counted):
                yield counted, counted + step


def _company(shared: int, threshold: float):
    """Members of lists that have somebody to be compared with there."""
    most = most_signs(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches):
            some = np.zeros(len(group), bool)
            bits = np.asarray(table.column("signs"))
            for a, b in _meetings(table, group, shared):
                alike = np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)) <= most
                some[a[alike]] = some[b[alike]] = True
            yield from table.select(["key", "size", "pair", "side", "node"]).filter(pa.array(some)).combine_chunks().to_batches()
    return run


def _roots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest row connected with each row by links (a, b)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(shared: int, threshold: float):
    """For each list: a node's number of linked vectors, and one linked node that leads to the smallest it hangs together with."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches):
            table = table.combine_chunks()
            size = len(group)
            weights = np.asarray(table.column("weight"), np.int64)
            links = np.zeros(size, np.int64)
            found_a, found_b = [], []
            units = np.zeros((size, int(np.asarray(table.column("size")).max())))
            for rows, of_length in unit_vectors(table.column("vector").combine_chunks()):
                units[rows, :of_length.shape[1]] = of_length
            for a, b in _meetings(table, group, shared):
                near = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
                a, b = a[near], b[near]
                links[a] += weights[b]
                links[b] += weights[a]
                found_a.append(a)
                found_b.append(b)
            if not links.any():
                continue
            root = _roots(np.concatenate(found_a), np.concatenate(found_b), size)
            some = np.flatnonzero(links)
            node = table.column("node").combine_chunks()
            yield pa.record_batch([node.take(pa.array(some)), node.take(pa.array(root[some])), pa.array(links[some])],
                                  ["a", "b", "links"])
    return run


def _blocked(members: DataFrame, block: int) -> DataFrame:
    """Rows of lists of more than `block` members once for every other block of the list; `side` is -1 within one block."""
    sizes = members.groupBy("key", "size").agg(F.count("*").alias("n")).filter("n > 1")
    rows = members.join(sizes, ["key", "size"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("mine", "other").cast("long") * F.col("blocks") + F.greatest("mine", "other")
    return rows.select("key", "size", pair.alias("pair"), F.when(F.col("mine") == F.col("other"), -1).otherwise(
        F.col("mine")).alias("side"), "node")


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("key", "size", "pair").sortWithinPartitions("key", "size", "pair")


def sampled_pivots(rows: DataFrame, total: int, number: int, threshold: float, sample: int = SAMPLE) -> np.ndarray:
    """Pivots from at most `sample` distinct vectors of the `total` rows, drawn by a hash of their components."""
    drawn = F.xxhash64(F.lit(13), "vector")
    some = rows.filter("vector IS NOT NULL").select("vector", drawn.alias("drawn"))
    if total > 2 * sample:
        # This range of hashes holds about twice the sample, so few rows are ordered; copies count once.
        some = some.filter(F.col("drawn") < int((4 * sample / total - 1) * 2 ** 63))
    some = some.groupBy("drawn").agg(F.first("vector").alias("vector")).orderBy("drawn").limit(sample)
    parts = unit_vectors(some.select("vector").toArrow().column("vector").combine_chunks())
    commonest = max(parts, key=lambda part: len(part[0]), default=(None, np.zeros((0, 1))))[1]
    return choose_pivots(commonest, number, threshold - SLACK)


def near_duplicates(rows: DataFrame, threshold: float = 0.9, shared: int = SHARED, prefix: int | None = None,
                    pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; `rows` has vec_id and `vector` (an array of numbers)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    total = rows.count()
    chosen = sampled_pivots(rows, total, pivots or pivot_number(total), threshold)
    prefix = prefix or prefix_length(len(chosen))
    held = rows.sparkSession.sparkContext.broadcast(chosen)
    kind = rows.schema["vector"].dataType.simpleString()
    points = written(rows.mapInArrow(_describe(held, prefix), f"vec_id long, node binary, pivots array<int>, "
                                     f"signs long, vector {kind}"), "points")
    held.destroy()
    nodes = written(points.filter("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"), F.first("pivots").alias("pivots"),
        F.first("signs").alias("signs"), F.first("vector").alias("vector")), "nodes")
    postings = nodes.select("node", "pivots", F.size("vector").alias("size")).mapInArrow(
        _postings(shared), "key long, size int, node binary")
    members = _blocked(written(postings, "postings"), block)
    by_pivots = _in_order(members.join(nodes.select("node", "pivots", "signs"), "node"))
    company = written(by_pivots.mapInArrow(_company(shared, threshold), "key long, size int, pair long, side int, node binary"), "company")
    whole = _in_order(company.join(nodes.select("node", "pivots", "vector", "weight"), "node"))
    found = written(whole.mapInArrow(_verified(shared, threshold), "a binary, b binary, links long"), "links")
    parts = components(found.select("a", "b"))
    named = written(nodes.select("node", "vec_id").join(parts, "node"), "named")
    least = named.groupBy("component").agg(F.min("vec_id").alias("least"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = written(nodes.select("node", "weight", "vec_id").join(named.join(least, "component").select("node", "least"), "node", "left")
                     .join(links, "node", "left").select(
                         "node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                         F.coalesce("least", "vec_id").alias("component_id")), "labels")
    linked = points.filter("node IS NOT NULL").select("vec_id", "node").join(labels, "node").select(
        "vec_id", "n_links", "component_id")
    alone = points.filter("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
