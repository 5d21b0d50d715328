"""Sources interleaved to target weights by Pfair scheduling.

The documents of a source are put in a shuffled but fixed order and cut into blocks. With whole-number
weights a of sum A, block j of a source (from 0) may not come before slot floor(j * A / a), its
release, and must come before slot ceil((j + 1) * A / a), its deadline. Taking in each slot the released
block of the earliest deadline meets all deadlines, so at every slot each source has had its share
to within less than one block. The schedule repeats after A slots: it is worked out once for
A slots, whatever the amount of data, and every block's slot follows by arithmetic. When a source has no
blocks left, a new phase begins in which the others share by their weights. Every document
comes once.

Work on the driver is bounded by the number of sources and the sum of weights, never by
documents: only block counts per source are collected. Numbering documents within a source goes by
buckets of bounded size, so a source with most of the rows is no single task.

A null source is a source of its own; sources without a given weight, or with less than 1, have weight 1. Repeated rows
are documents of their own (their order among themselves is left open).
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16
BUCKET = 2048
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Target weights by source where a caller gives none: equal shares, the first three sources doubled.
DEFAULT_WEIGHTS = {"src0": 2, "src1": 2, "src2": 2}


def one_round(weights: dict) -> list:
    """The sources of slots 0 to A - 1: earliest deadline first among released blocks."""
    total = sum(weights.values())
    waiting = [(0, repr(s), s, 0) for s in weights]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, name, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), name, s, j))
        _, name, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], name, s, j + 1))
    return out


def phases(blocks: dict, weights: dict) -> list[dict]:
    """For each phase and source: blocks taken before, first slot, round length, slots of its blocks in a round.

    A phase ends with the slot in which some source gives its last block.
    """
    left, taken, base, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    left = {s: n for s, n in left.items() if n > 0}
    while left:
        a = {s: weights[s] for s in left}
        order = one_round(a)
        offsets = {s: [i for i, x in enumerate(order) if x == s] for s in left}
        last = {s: (n - 1) // a[s] * len(order) + offsets[s][(n - 1) % a[s]] for s, n in left.items()}
        end = min(last.values()) + 1
        for s in left:
            out.append({"source": s, "taken": taken[s], "base": base, "round": len(order), "offsets": offsets[s]})
        turns, part = divmod(end, len(order))
        for s in list(left):
            got = turns * a[s] + sum(x < part for x in offsets[s])
            taken[s] += got
            left[s] -= got
            if not left[s]:
                del left[s]
        base += end
    return out


def numbered(rows: DataFrame, key: str, order: str, bucket: int = BUCKET) -> DataFrame:
    """rows with `number`: a dense count from 0 for each value of `key` (no nulls), in the order of a hash of `order`.

    Rows are counted by (key, bucket) first and only these counts are summed up along a key; the count
    within a bucket and the sum meet in one partitioning, so the rows themselves move once.
    """
    buckets = max(1, -(-rows.count() // bucket))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    counts = dealt.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(key, "_b", (F.sum("_n").over(Window.partitionBy(key).orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(F.xxhash64(F.lit(7), order), order))
    out = dealt.withColumn("_i", inside).join(before, [key, "_b"])
    return out.withColumn("number", F.col("_before") + F.col("_i") - 1).drop("_b", "_i", "_before")


def source_key(source: Column) -> Column:
    """A key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """The columns of COLUMNS that docs has, and `block`, `slot`, `release`, `deadline` and `position`.

    (slot, position) is the mixed order; a block may take the slots from release to deadline, the
    deadline excluded. Weights are whole numbers by source; without any, all sources are equal.
    """
    carried = [c for c in COLUMNS if c in docs.columns]
    rows = docs.select(*carried, source_key(F.col("source")).alias("_s"))
    counted = {r["_s"]: -(-r["n"] // block) for r in rows.groupBy("_s").agg(F.count("*").alias("n")).collect()}
    given = {f"s{name}": int(n) for name, n in (weights or {}).items() if name is not None}
    known = {s: max(1, given.get(s, 1)) for s in counted}
    plan = [(p["source"], p["taken"], p["base"], p["round"], p["offsets"]) for p in phases(counted, known)]
    table = docs.sparkSession.createDataFrame(
        plan, "_s string, _taken long, _base long, _round long, _offsets array<long>")
    # One row a source: its phases in order. At most sources * (sources + 1) / 2 entries of at most the largest weight.
    table = table.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct(
        "_taken", "_base", "_round", "_offsets"))).alias("_phases"))
    out = numbered(rows, "_s", "doc_id", bucket).join(F.broadcast(table), "_s")
    out = out.withColumn("_j", F.floor(F.col("number") / block)).withColumn(
        "_p", F.element_at(F.filter("_phases", lambda p: p["_taken"] <= F.col("_j")), -1))
    j, size = F.col("_j") - F.col("_p._taken"), F.size("_p._offsets")
    slot = F.col("_p._base") + F.floor(j / size) * F.col("_p._round") + F.element_at(
        "_p._offsets", (j % size + 1).cast("int"))
    return out.select(
        *carried, F.col("_j").alias("block"), slot.cast("long").alias("slot"),
        (F.col("_p._base") + F.floor(j * F.col("_p._round") / size)).alias("release"),
        (F.col("_p._base") + F.ceil((j + 1) * F.col("_p._round") / size)).alias("deadline"),
        (F.col("number") % block).alias("position"))
