"""Exact Jaccard self-join of word-shingle sets, by regions around pivots.

Jaccard distance is a metric, but the distance of unrelated texts is close to 1, so a few document pivots
would separate nothing. Regions are therefore formed in two steps.

1. Every set looks for pivots through its rarest shingles. Two sets that reach the threshold share one of
   their first size - ceil(t * size) + 1 shingles in any common order (here by hash, common ones last).
   Most such meetings are chance. A shingle of two sets counts only if their sizes and its places in
   both allow the threshold (what comes after a first common shingle bounds the overlap); at a shingle of more sets,
   those of like size (windows of two neighbouring size classes) meet, if one of them holds it early enough to be the
   smaller of a linked pair. All that meet so belong to the region of one pivot, the set of highest
   priority among them (the least digest); since priorities are global, most shingles of a group of copies
   choose the same pivot. A set is replicated to the regions of all its pivots.
2. Only sets left by this are read again, for their texts and counts of shingles in 128 fixed classes. A set keeps its
   place in a region only if some other set there can reach the threshold by sizes and counts: the L1
   distance of the counts is never more than the symmetric difference. Regions fall apart into the parts that hang
   together by this test, and parts that share a set become one region, unless less is moved when they stay apart.
3. Regions too large for one task are divided again around a pivot of their own: rings of the
   threshold's width by exact distance to it. By the triangle inequality linked sets lie in one ring or in
   neighbouring rings, so each ring is joined with the next one. This is repeated to a fixed depth; what is
   still large after that is joined block by block.
4. A task joins its sets exactly and gives only the links that connect sets not yet connected there: the
   groups are whole, without all pairs of a group of copies.

Identical sets are one node from the start (128-bit digests), so exact copies cost nothing. Shingles
are compared as 64-bit hashes; nodes are named by 64 bits of their digest.

Null and empty texts have no shingles and no links. A text of fewer words than a shingle is one shingle.
Rows without doc_id get no component. Rows are documents; of equal ids with different texts
each row keeps its own set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.bloom import build, holds
from llm.common import removed, written
from llm.components import components
from llm.sketch import cell, common_cells
from llm.words import Words, mix, sequence_hash, slices

# Counts that move are few; a task counts more finely for itself.
CLASSES = 128
FINE_CLASSES = 512
CROWD = 64
BLOCK, BLOCK_SHINGLES, LARGE, DEPTH = 1024, 1_000_000, 8, 2
SLICE = 1 << 20
MOST_TOKENS = 1 << 17
# What a task has in hand at once beside a group that is larger: bytes of its rows, and texts unpacked together.
CHUNK_BYTES, PIECE = 4 << 20, 64
OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for a, b, raw, offsets in slices(column, SLICE):
        words = Words(raw, offsets)
        hashes = words.hashes(lower=True)
        runs = sequence_hash(hashes, width)
        for i in range(b - a):
            start, end = int(words.first[i]), int(words.first[i + 1])
            if end - start >= width:
                yield np.unique(runs[start:end - width + 1])
            elif end > start:
                yield sequence_hash(hashes[start:end], end - start, seed=1 + end - start)
            else:
                yield np.zeros(0, np.uint64)


def prefix_length(size: int, num: int, den: int) -> int:
    return size + (-num * size) // den + 1 if size else 0


def class_counts(found: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    return np.minimum(np.bincount(((found >> np.uint64(7)) % np.uint64(classes)).astype(np.int64), minlength=classes),
                      255).astype(np.uint8)


def digests(found: np.ndarray) -> tuple[int, int]:
    return (int(mix(found).sum(dtype=np.uint64).view(np.int64)),
            int(mix(found ^ OTHER).sum(dtype=np.uint64).view(np.int64)))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), *digests(s)) for s in shingle_sets(batch.column("text"), width)]
            n, one, two = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                                   pa.array(two, pa.int64())], ["doc_id", "n_shingles", "node", "two"])
    return run


def rarity(tokens: np.ndarray, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for tokens of ordinary cells, the cell's count for tokens of crowded ones."""
    cells, counts = late
    if not len(cells):
        return np.zeros(len(tokens), np.uint32)
    mine = cell(tokens)
    at = np.minimum(np.searchsorted(cells, mine), len(cells) - 1)
    return np.where(cells[at] == mine, counts[at], 0)


def prefix(found: np.ndarray, want: int, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first `want` shingles by hash, those of crowded cells at the end, the fullest cell last."""
    if not rarity(found[:want], late).any():
        return found[:want].copy()  # a view would keep the whole set in memory
    order = np.lexsort((found, rarity(found, late)))
    return found[order[:want]]


def _prefix_tokens(width: int, num: int, den: int):
    def run(batch: pa.RecordBatch) -> np.ndarray:
        # Copies: a view would keep its whole set in memory.
        out = [s[:prefix_length(len(s), num, den)].copy() for s in shingle_sets(batch.column("text"), width)]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)
    return run


def _placed_tokens(nodes: list[np.ndarray], tokens: list[np.ndarray], spots: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(tokens).view(np.int64)),
                            pa.array(np.concatenate(spots))], ["node", "token", "spot"])


def _prefixes(width: int, num: int, den: int, late):
    """(node, token, spot) of the first shingles of each set; copies in a task count once. spot: size << 32 | place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, crowd = set(), late.value
        for batch in batches:
            nodes, out, spots, held = [], [], [], 0
            for s in shingle_sets(batch.column("text"), width):
                node = digests(s)[0]
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                first = prefix(s, prefix_length(len(s), num, den), crowd)
                out.append(first)
                nodes.append(np.full(len(first), node, np.int64))
                spots.append((np.int64(len(s)) << 32) + np.arange(len(first)))
                held += len(first)
                if held >= MOST_TOKENS:
                    yield _placed_tokens(nodes, out, spots)
                    nodes, out, spots, held = [], [], [], 0
            if out:
                yield _placed_tokens(nodes, out, spots)
    return run


def crowded(docs: DataFrame, width: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the sketch far above the mean, sorted, and their counts: an order of shingles by how common they are."""
    return common_cells(docs.select("text"), _prefix_tokens(width, num, den), 2, CROWD)


def blocked(members: DataFrame, block: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """members of `region` with `pair` and `side`: every two members meet in one (region, pair).

    A region has as many blocks as its rows (and the sum of `weight`) ask for; block i meets block j once.
    """
    total = F.sum(weight) if weight else F.lit(0)
    sizes = members.groupBy("region").agg(F.count("*").alias("_n"), total.alias("_w"))
    sizes = sizes.select("region", F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_w") / max(most, 1)) if weight else F.lit(1))
                         .cast("int").alias("_blocks"))
    sizes = written(sizes, "region-sizes")
    mine = F.pmod(F.xxhash64("region", "node"), F.col("_blocks")).cast("int")
    out = members.join(sizes, "region").withColumn("_mine", mine).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return out.withColumn("pair", F.least("_mine", "_other") * F.col("_blocks") + F.greatest("_mine", "_other")).withColumn(
        "side", F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") < F.col("_other"), 0).otherwise(1)
    ).drop("_mine", "_other", "_blocks")


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Whole groups of equal (region, pair) from sorted batches, many small groups at a time."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        size += batch.nbytes
        if count < rows and size < CHUNK_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        region, pair = table["region"].to_numpy(), table["pair"].to_numpy()
        new = np.flatnonzero((region[1:] != region[:-1]) | (pair[1:] != pair[:-1])) + 1
        if len(new):
            yield table.slice(0, int(new[-1]))
            table = table.slice(int(new[-1])).combine_chunks()
        held, count, size = table.to_batches(), 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(table: pa.Table) -> np.ndarray:
    region, pair = table["region"].to_numpy(), table["pair"].to_numpy()
    new = np.flatnonzero((region[1:] != region[:-1]) | (pair[1:] != pair[:-1])) + 1
    return np.concatenate([[0], new, [table.num_rows]])


def near_rows(counts: np.ndarray, size: np.ndarray, side: np.ndarray, num: int, den: int) -> Iterator[tuple]:
    """For each row i the rows that can reach the threshold with it, each pair once, nearest first by the L1 distance.

    Side 2 meets itself, side 0 meets side 1. One row's partners at a time: a group's pairs are never held.
    """
    order = np.argsort(size, kind="stable")
    counts, size, side = counts[order].astype(np.int16), size[order], side[order]
    ends = np.searchsorted(size, size * den // num, side="right")
    for i in range(len(size)):
        others = np.arange(i + 1, ends[i])
        if side[i] != 2:
            others = others[side[i + 1:ends[i]] != side[i]]
        if not len(others):
            continue
        apart = np.abs(counts[others] - counts[i]).sum(axis=1, dtype=np.int64)
        ok = np.flatnonzero(apart * (den + num) <= (den - num) * (size[others] + size[i]))
        if len(ok):
            yield order[i], order[others[ok[np.argsort(apart[ok], kind="stable")]]]


def _counts_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8).reshape(-1, CLASSES)


def _near(num: int, den: int):
    """Members that another member can reach; their new region is the part of the region that hangs together so."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            counts, bounds = _counts_of(table), _groups(table)
            size, side, node = (table[c].to_numpy() for c in ("n_shingles", "side", "node"))
            part, keep = np.arange(table.num_rows), np.zeros(table.num_rows, bool)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                mine = part[a:b]
                for i, others in near_rows(counts[a:b], size[a:b], side[a:b], num, den):
                    keep[a + i] = keep[a + others] = True
                    apart = np.unique(mine[others[mine[others] != mine[i]]])
                    if len(apart):
                        mine[np.isin(mine, apart)] = mine[i]
            at = np.flatnonzero(keep)
            yield pa.record_batch([pa.array(node[part[at]]), pa.array(node[at]), pa.array(size[at])],
                                  ["region", "node", "n_shingles"])
    return run


def _exact(width: int, num: int, den: int):
    """Links that connect sets not connected before, in each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, 1000):
            bounds = _groups(table)
            size, side, node = (table[c].to_numpy() for c in ("n_shingles", "side", "node"))
            left, right = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                # One group's sets at a time: at most those of two blocks.
                sets = unpacked(table["packed"].slice(a, b - a).to_pylist(), width)
                counts = np.stack([class_counts(s, FINE_CLASSES) for s in sets])
                part = np.arange(b - a)  # the connected part of each set so far
                for i, others in near_rows(counts, size[a:b], side[a:b], num, den):
                    others = others[part[others] != part[i]]
                    while len(others):
                        j, others = others[0], others[1:]
                        if linked(sets[i], sets[j], num, den):
                            left.append(node[a + i])
                            right.append(node[a + j])
                            part[part == part[j]] = part[i]
                            others = others[part[others] != part[i]]
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
    return run


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    shared = common(x, y)
    return den * shared >= num * (len(x) + len(y) - shared)


def _rings(width: int, num: int, den: int):
    """Distance to the region's pivot, in widths of the threshold; and whether it is a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring, link = [], []
            for k in range(batch.num_rows):
                x, y = unpacked([batch.column(c)[k].as_py() for c in ("packed", "pivot_packed")], width)
                shared = common(x, y)
                union = len(x) + len(y) - shared
                # floor(distance / (1 - t)) in whole numbers
                ring.append(den * (union - shared) // ((den - num) * union))
                link.append(den * shared >= num * union)
            names = ["region", "node", "n_shingles", "pivot"]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(ring, pa.int64()), pa.array(link)],
                                  [*names, "ring", "link"])
    return run


def _wanted_texts(width: int, wanted):
    """Class counts and compressed texts, smaller than their sets, of rows whose id passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, bits = wanted.value
        packed, seen = np.frombuffer(data, np.uint8), set()
        for batch in batches:
            some = batch.filter(pa.array(holds(packed, bits, batch.column("doc_id").to_numpy())))
            ids, nodes, counts, texts = [], [], [], []
            for doc, text, s in zip(some.column("doc_id").to_pylist(), some.column("text"),
                                    shingle_sets(some.column("text"), width), strict=True):
                node = digests(s)[0]
                if len(s) and (doc, node) not in seen:
                    seen.add((doc, node))
                    ids.append(doc)
                    nodes.append(node)
                    counts.append(class_counts(s).tobytes())
                    texts.append(zstandard.compress(text.as_py().encode("utf-8", "surrogatepass"), 3))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(counts, pa.binary()),
                                   pa.array(texts, pa.binary())], ["rep", "node", "counts", "packed"])
    return run


def unpacked(packed: list[bytes], width: int) -> list[np.ndarray]:
    """The sets of compressed texts; only a few texts are unpacked at a time."""
    found = []
    for k in range(0, len(packed), PIECE):
        texts = pa.array([zstandard.decompress(x) for x in packed[k:k + PIECE]], pa.binary()).cast(pa.string())
        found.extend(shingle_sets(texts, width))
    return found


def _sorted_groups(df: DataFrame) -> DataFrame:
    return df.repartition("region", "pair").sortWithinPartitions("region", "pair")


def _passing(wanted, column: str):
    """Rows whose `column` passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, bits = wanted.value
        packed = np.frombuffer(data, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(holds(packed, bits, batch.column(column).to_numpy())))
    return run


def _reach(low: str, high: str, num: int, den: int) -> Column:
    """Whether two sets, by their spots at a common shingle, can reach the threshold with no earlier one in common."""
    sizes = [F.shiftright(x, 32) for x in (low, high)]
    left = F.least(*(n - F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)) for n, x in zip(sizes, (low, high), strict=True)))
    return (F.greatest(*sizes) * num <= F.least(*sizes) * den) & (left * (den + num) >= (sizes[0] + sizes[1]) * num)


def meetings(held: DataFrame, num: int, den: int) -> DataFrame:
    """region, node: sets that can have a link by their sizes and by the places of a common shingle."""
    shared = written(held.groupBy("token").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.min("spot").alias("from"), F.max("spot").alias("to"),
        F.count("*").alias("n")).filter("low < high"), "shared")
    two = shared.filter(F.col("n") == 2).filter(_reach("from", "to", num, den)).select(
        F.col("low").alias("region"), F.explode(F.array("low", "high")).alias("node"))
    more = shared.filter("n > 2").select("token")
    count = more.count()
    if not count:
        members = written(two.distinct(), "members")
        removed(shared)
        return members
    wanted = held.sparkSession.sparkContext.broadcast(build(more, count))
    size, place = F.shiftright("spot", 32), F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF))
    rows = written(held.mapInArrow(_passing(wanted, "token"), held.schema).join(more, "token").distinct(), "crowds")
    wanted.destroy()
    # Linked sizes differ by a factor of den / num at most: by one size class, a little wider than that, at most.
    step = math.log(den / num) * 1.001 if den > num else 1.0
    band = F.floor(F.log(size.cast("double")) / step)
    early = (size - place) * (den + num) >= 2 * num * size
    rows = rows.select("token", "node", size.alias("size"), early.alias("early"),
                       F.explode(F.array(band, band - 1)).alias("band"))
    firsts = written(rows.groupBy("token", "band").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.when(F.col("early"), F.col("size"))).alias("least"))
        .filter("low < high AND least IS NOT NULL"), "firsts")
    many = rows.join(firsts, ["token", "band"]).filter("size >= least").select(F.col("low").alias("region"), "node")
    members = written(two.unionAll(many).distinct(), "members")
    removed(shared, rows, firsts)
    return members


def regions(members: DataFrame, wanted: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """region, node, n_shingles: members that another member of the region can reach by sizes and class counts."""
    known = wanted.join(texts.select("rep", "node", "counts"), ["rep", "node"]).select("node", "n_shingles", "counts")
    # Blocks are dealt on names alone, so the counts move once to them.
    near = _sorted_groups(blocked(members, BLOCK).join(known, "node")).select("region", "pair", "side", "node", "n_shingles", "counts")
    return written(near.mapInArrow(_near(num, den), "region long, node long, n_shingles long").distinct(), "near")


def merged(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Regions that share a set become one, so each set is in one region only, unless that moves more shingles: where chance
    ties many regions into one of many blocks, they stay apart. Linked sets share a region either way."""
    parts = components(members.select(F.col("region").alias("a"), F.col("node").alias("b")))
    rows = written(members.join(parts, "node"), "tied")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    moved = (F.sum("n_shingles") * blocks).alias("moved")
    together = rows.select("component", "node", "n_shingles").distinct().groupBy("component").agg(moved)
    apart = rows.groupBy("component", "region").agg(moved).groupBy("component").agg(F.sum("moved").alias("apart"))
    choice = together.join(apart, "component").select("component", (F.col("moved") > F.col("apart")).alias("stay"))
    region = F.when(F.col("stay"), F.col("region")).otherwise(F.col("component"))
    return written(rows.join(choice, "component").select(region.alias("region"), "node", "n_shingles").distinct(), "merged")


def links(docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int, block: int = BLOCK,
          depth: int = DEPTH) -> DataFrame:
    """a, b: links between different sets, enough to connect everything that is connected."""
    context = docs.sparkSession.sparkContext
    late = context.broadcast(crowded(docs, width, num, den))
    held = written(docs.select("text").mapInArrow(_prefixes(width, num, den, late), "node long, token long, spot long"),
                   "prefixes")
    late.destroy()
    members = meetings(held, num, den)
    removed(held)
    wanted = written(nodes.join(members.select("node").distinct(), "node").select("node", "n_shingles", "rep"), "wanted")
    shared = context.broadcast(build(wanted.select("rep"), wanted.count()))
    texts = written(docs.select("doc_id", "text").mapInArrow(
        _wanted_texts(width, shared), "rep long, node long, counts binary, packed binary"), "texts")
    shared.destroy()
    members = regions(members, wanted, texts, num, den)
    own = written(wanted.join(members.select("node").distinct(), "node").select("rep", "node"), "own")
    # Most texts are not wanted any more and stay in their task.
    every = texts.select("rep", "node", "packed")
    shared = context.broadcast(build(own.select("node"), own.count()))
    texts = written(every.mapInArrow(_passing(shared, "node"), every.schema).join(own, ["rep", "node"]).select("node", "packed"),
                    "own-texts")
    shared.destroy()
    removed(every)
    members = merged(members, block)
    found = []
    for level in range(depth):
        sizes = members.groupBy("region").agg(F.count("*").alias("n"), F.min(F.struct(
            F.xxhash64(F.lit(level), "node").alias("p"), "node")).alias("first"))
        large = written(sizes.filter(F.col("n") > LARGE * block).select("region", F.col("first.node").alias("pivot")), "large")
        if large.isEmpty():
            break
        pivots = written(large.join(texts.select(F.col("node").alias("pivot"), F.col("packed").alias("pivot_packed")),
                                    "pivot"), "region-pivots")
        inside = members.join(pivots, "region").join(texts, "node")
        rings = written(inside.mapInArrow(_rings(width, num, den), "region long, node long, n_shingles long, pivot long, "
                                          "ring long, link boolean"), "rings")
        found.append(rings.filter("link AND node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        # Ring k meets itself and ring k + 1 in the new region k.
        divided = rings.withColumn("ring", F.explode(F.array(F.col("ring"), F.col("ring") - 1))).filter("ring >= 0").select(
            F.xxhash64(F.lit(level), "region", "ring").alias("region"), "node", "n_shingles")
        members = written(members.join(large, "region", "left_anti").unionAll(divided), "divided")
    placed = blocked(members, block, "n_shingles", BLOCK_SHINGLES).join(texts, "node")
    exact = _sorted_groups(placed).select("region", "pair", "side", "node", "n_shingles", "packed")
    found.append(exact.mapInArrow(_exact(width, num, den), "a long, b long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def labelled_sets(docs: DataFrame, width: int, num: int, den: int, block: int = BLOCK,
                  depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Sets of rows (doc_id, n_shingles, node), and for each node its class and the least doc_id of it, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(docs.mapInArrow(_sets(width), "doc_id long, n_shingles long, node long, two long"),
                   "shingle-sets")
    usable = docs.filter("doc_id IS NOT NULL")
    nodes = written(sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node", "two", "n_shingles").agg(
        F.min("doc_id").alias("rep")).drop("two"), "nodes")
    parts = components(links(usable, nodes, width, num, den, block, depth))
    joined = written(nodes.select("node", "rep").join(parts, "node"), "joined")
    least = written(joined.groupBy("component").agg(F.min("rep").alias("least")), "least")
    linked_ids = joined.join(least, "component").select("node", "component", "least")
    label = written(nodes.select("node", "rep").join(linked_ids, "node", "left").select(
        "node", F.coalesce("component", "node").alias("class"), F.coalesce("least", "rep").alias("component_id")), "labels")
    return sets, label


def jaccard_classes(docs: DataFrame, width: int, num: int, den: int, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; sets link when den * common >= num * union."""
    sets, label = labelled_sets(docs, width, num, den, block, depth)
    full = sets.filter("n_shingles > 0").join(label, "node").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    none = sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    lonely = sets.filter("n_shingles > 0 AND doc_id IS NULL").join(label, "node", "left_anti").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionAll(none).unionAll(lonely)


def first_of_class(docs: DataFrame, width: int, num: int, den: int, carry: list[str]) -> DataFrame:
    """The columns of `carry` of one row of each class, the one of the smallest doc_id and then text.

    Rows without words or without doc_id all stay. Rows are documents: of equal ids with different texts each
    row is in the class of its own set. `carry` holds doc_id and text. Only rows whose id may have to go move; the
    others stay in their task.
    """
    sets, label = labelled_sets(docs.select("doc_id", "text"), width, num, den)
    rows = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "node").join(label, "node")
    classes = written(rows.groupBy("doc_id", "node", "class", "component_id").agg(F.count("*").alias("n")), "classes")
    going = classes.groupBy("doc_id", "class").agg(F.sum("n").alias("n"), F.min("component_id").alias("c")).filter(
        "n > 1 OR c < doc_id").select("doc_id").distinct()
    going = written(going, "going")
    shared = docs.sparkSession.sparkContext.broadcast(build(going, going.count()))

    @F.pandas_udf("long")
    def may_go(ids: pd.Series, texts: pd.Series) -> pd.Series:
        """The node of a row that may have to go; null for rows that stay."""
        packed, bits = shared.value
        some = np.flatnonzero(holds(np.frombuffer(packed, np.uint8), bits, ids.fillna(0).to_numpy(np.int64)) & ids.notna().to_numpy())
        out = pd.Series([None] * len(ids), dtype="Int64")
        found = [digests(x)[0] if len(x) else None for x in shingle_sets(pa.array(texts.iloc[some].tolist(), pa.string()), width)]
        out.iloc[some] = pd.array(found, "Int64")
        return out

    marked = docs.select(*carry, may_go(F.col("doc_id").cast("long"), F.col("text")).alias("_node"))
    stay = classes.filter("doc_id = component_id").select("doc_id", F.col("node").alias("_node"), F.col("class").alias("_class"))
    number = F.row_number().over(Window.partitionBy("doc_id", "_class").orderBy("text"))
    chosen = marked.filter("_node IS NOT NULL").join(stay, ["doc_id", "_node"]).withColumn("_n", number).filter("_n = 1")
    return marked.filter("_node IS NULL").select(*carry).unionAll(chosen.select(*carry))
