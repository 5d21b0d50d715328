"""The prefix trie of conversations, by collapsing whole sequences first.

1. Every turn becomes a 128-bit digest of role and text where it is read; texts do not move. Conversations are
   rebuilt as sequences of digests, and a running digest names every prefix.
2. Identical conversations are one weighted sequence. Its end list (the ids of its conversations in order) is
   joined to pieces of bounded size range by range and then hashed as a stream, so that a sequence which a third
   of all conversations share is spread over tasks.
3. Sequences that are proper prefixes of others are found by an anti-join on prefixes; the rest are leaves.
4. Prefixes of the distinct sequences are aggregated with their weights. Sums over subtrees need no tree walk:
   every node is charged to one leaf below it (the smallest), and then the sums along the
   leaves' paths, taken from the end, add up node by node.

Turns go by number, null first; of equal numbers by role and text (null as empty). Repeated rows are turns of their own.
Rows without conv_id take no part. An empty table has no nodes, not even a root. Columns other than conv_id, turn, role
and text are not looked at. Digests are the first 128 bits of SHA-256; collisions are not resolved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import written

WORD = "[^\\x20\\x09-\\x0D]+"
ROOT = b"\x00" * 16
# Ids of an end list that travel as one text.
PIECE = 4096


def crc_head(conv: Column) -> Column:
    """Turns that a conversation takes over: the unsigned CRC-32 of its decimal id, modulo 4."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def numbered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, at (from 1 in order), digest and words of every turn that has a conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    body = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    digest = F.unhex(F.substring(F.sha2(body, 256), 1, 32))
    rows = rows.withColumn("conv_id", F.col("conv_id").cast("long")).filter("conv_id IS NOT NULL")
    turns = rows.select("conv_id", "turn", digest.alias("digest"),
                        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"))
    turns = written(turns, "turns")
    # Only turns whose number occurs twice have their texts compared.
    tied = written(turns.groupBy("conv_id", "turn").agg(F.count_distinct("digest").alias("n")).filter("n > 1")
                   .select("conv_id", "turn"), "tied")
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("place"), "digest"]
    if tied.isEmpty():
        placed = turns.withColumn("place", F.lit(0))
    else:
        same = tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
        unclear = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), digest.alias("digest")).join(
            same, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left_semi").distinct()
        places = unclear.withColumn("place", F.row_number().over(
            Window.partitionBy("conv_id", "turn").orderBy("role", "text"))).select(
            F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("g"), "place")
        on = (F.col("conv_id") == F.col("c")) & (F.col("digest") == F.col("g")) & F.col("turn").eqNullSafe(F.col("t"))
        placed = turns.join(places, on, "left").drop("c", "t", "g")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")
    return written(placed.select("conv_id", at.alias("at"), "digest", "words"), "numbered")


def rebuilt_turns(turns: DataFrame, head: Callable[[Column], Column] = crc_head, family: int = 20) -> DataFrame:
    """conv_id, origin, at, digest, words. Every conversation has a row of origin 0 that is no turn; then come
    the first `head` turns of its family's first conversation (origin 1), then its own after as many (origin 2)."""
    none = F.lit(None)
    convs = turns.filter("at = 1").select("conv_id", head(F.col("conv_id")).cast("long").alias("head"),
                                          (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    tops = convs.select("conv_id", F.lit(0).alias("origin"), F.lit(0).cast("long").alias("at"),
                        none.cast("binary").alias("digest"), none.cast("long").alias("words"))
    # A family has at most `family` conversations with non-negative ids, so no key of this join is hot.
    bases = turns.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), "at", "digest", "words")
    taken = bases.join(convs, "base").filter("at <= head").select("conv_id", F.lit(1).alias("origin"), "at", "digest", "words")
    own = turns.filter(F.col("at") > head(F.col("conv_id"))).select("conv_id", F.lit(2).alias("origin"), "at", "digest", "words")
    return tops.unionAll(taken).unionAll(own)


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names every prefix, row by row in order; a row is given when it is known whether it is its conversation's last."""
    names = ["conv_id", "depth", "node", "parent", "words", "last"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    before: tuple | None = None
    chain = hashlib.sha256()
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for conv, digest, words in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "digest", "words")], strict=True):
            fresh = before is None or conv != before[0]
            if before is not None:
                for column, value in zip(out, (*before, fresh), strict=True):
                    column.append(value)
            if fresh:
                chain = hashlib.sha256()
                before = (conv, 0, ROOT, None, 0)
            else:
                chain.update(digest)
                before = (conv, before[1] + 1, chain.digest()[:16], before[2], words)
        yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)
    if before is not None:
        yield pa.record_batch([pa.array([v], t) for v, t in zip((*before, True), types, strict=True)], names)


def paths(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, words and last for every prefix of every rebuilt conversation, the root included."""
    # The origin-0 row opens every conversation, and a partition holds whole conversations: rows only stream through.
    ordered = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "origin", "at").select("conv_id", "digest", "words")
    shape = "conv_id long, depth long, node binary, parent binary, words long, last boolean"
    return written(ordered.mapInArrow(_paths, shape), "paths")


def _pieces(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids of one sequence, joined by commas."""
        node, ids = None, []
        names = ["node", "first", "n", "ids"]

        def piece() -> tuple:
            return node, ids[0], len(ids), ",".join(map(str, ids))
        for batch in batches:
            done = []
            for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (key != node or len(ids) >= size):
                    done.append(piece())
                    ids = []
                node = key
                ids.append(conv)
            columns = [list(c) for c in zip(*done, strict=True)] or [[], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)
        if ids:
            yield pa.record_batch([pa.array([v], t) for v, t in zip(piece(), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)
    return run


def _end_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence from its pieces in order; only the state of the hash is held."""
    names, types = ["node", "weight", "conv_id", "ends_sha256"], (pa.binary(), pa.int64(), pa.int64(), pa.string())
    node, first, weight, state = None, None, 0, hashlib.sha256()
    for batch in batches:
        done = []
        for key, conv, n, ids in zip(*[batch.column(c).to_pylist() for c in ("node", "first", "n", "ids")], strict=True):
            if key != node:
                if node is not None:
                    done.append((node, weight, first, state.hexdigest()))
                node, first, weight, state = key, conv, 0, hashlib.sha256()
            else:
                state.update(b",")
            weight += n
            state.update(ids.encode())
        columns = [list(c) for c in zip(*done, strict=True)] or [[], [], [], []]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    if node is not None:
        yield pa.record_batch([pa.array([v], t) for v, t in zip((node, weight, first, state.hexdigest()), types, strict=True)], names)


def weighted_sequences(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """node, weight, conv_id (the smallest) and ends_sha256 of every distinct whole sequence; `ends` has node and conv_id."""
    ranges = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id")
    pieces = ranges.mapInArrow(_pieces(piece), "node binary, first long, n long, ids string")
    whole = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "first", "n", "ids")
    return written(whole.mapInArrow(_end_lists, "node binary, weight long, conv_id long, ends_sha256 string"), "sequences")


def prefix_trie(conversations: DataFrame, head: Callable[[Column], Column] = crc_head, family: int = 20,
                piece: int = PIECE) -> DataFrame:
    """node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    every = paths(rebuilt_turns(numbered_turns(conversations), head, family))
    sequences = weighted_sequences(every.filter("last").select("node", "conv_id"), piece)
    # From here on only one conversation of each distinct sequence.
    chosen = sequences.select("conv_id", "weight")
    own = written(every.join(chosen, "conv_id").withColumnRenamed("conv_id", "leaf"), "prefixes")
    inner = own.filter("NOT last").select("node").distinct()
    leaves = written(sequences.join(inner, "node", "left_anti").select(F.col("conv_id").alias("leaf")), "leaves")
    own = own.join(leaves.withColumn("is_leaf", F.lit(True)), "leaf", "left")
    leaf = F.when(F.col("is_leaf"), F.col("leaf"))
    nodes = written(own.groupBy("node").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("words").alias("words"),
        F.sum("weight").alias("n_convs"), F.min("leaf").alias("conv_id"),
        F.count(leaf).alias("n_leaves"), F.min(leaf).alias("charged")), "nodes")
    # Sums along the leaves' paths from the end; a node's own saving lies on the path of the leaf it is charged to.
    saving = nodes.select(F.col("charged").alias("leaf"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                          F.lit(None).cast("binary").alias("node"))
    steps = own.filter("is_leaf").select("leaf", "depth", F.lit(0).cast("long").alias("saved"), "node").unionAll(saving)
    below = Window.partitionBy("leaf").orderBy(F.desc("depth"))
    steps = steps.withColumn("saved", F.sum("saved").over(below)).filter("node IS NOT NULL")
    # Everything about a node meets in one aggregation.
    facts = [("saved", steps.select("node", "saved")),
             ("children", nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("node"), F.lit(1).alias("children"))),
             ("ends", sequences.select("node", F.col("ends_sha256").alias("ends")))]
    rows = nodes
    for _, part in facts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    whole = written(rows.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.min("n_convs").alias("n_convs"), F.min("n_leaves").alias("n_leaves"),
        F.coalesce(F.sum("children"), F.lit(0)).cast("long").alias("n_children"), F.sum("saved").alias("saved_tokens"),
        F.coalesce(F.min("ends"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")), "trie")
    # A node with very many children is hot on one side only; the other side is unique, so the join can be split.
    above = whole.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(above, "parent", "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
