"""Long repeated passages, removed by compacting a De Bruijn graph of words.

Edges are runs of `window` consecutive words. Runs are bucketed by their minimizer (the smallest hash of
MINIMIZER consecutive words in the run, leftmost of equals): neighbouring runs with one minimizer form a
segment, so a document is a chain of segments, about one for every fourteen words.

1. Minimizers that occur once in all documents cannot belong to a repeated run; only the others are kept.
2. The documents' segments at the kept minimizers get 128-bit hashes of their whole content. Segments that
   occur twice consist of repeated runs only. Where a minimizer has several contents, the runs of one
   copy of each are counted against each other, which finds runs that repeat only partly.
3. Repeated segments that follow each other without branching are compacted into paths by pointer
   doubling joins, and the occurrences of a path in a document merge into one span of source coordinates.
   The second hashes, worked out at those coordinates, verify the spans.
4. Each document loses the words its spans cover.

Runs are judged on the input. Null and short texts have none. Rows are documents of their own: a
repeated row repeats all its runs. Rows of equal doc_id and text share their (equal) result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import written
from llm.words import BASE, Words, mix, sequence_hash, slices

WINDOW, MINIMIZER = 35, 8
OTHER = np.uint64(0xD6E8FEB86659FD93)
SLICE = 1 << 20


def _leftmost_least(values: np.ndarray, length: int) -> np.ndarray:
    """For each start the place of the least of `length` values, the leftmost of equals."""
    at, have = np.arange(len(values)), 1
    while have < length:
        step = min(have, length - have)
        a, b = at[:len(at) - step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        have += step
    return at


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    out[1:] = np.multiply.accumulate(np.full(max(n - 1, 0), base))
    return out


class Segments:
    """Segments of a slice: document, first run, number of runs, minimizer place and hash; places count in the slice."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int, minimizer: int):
        words = Words(raw, offsets)
        self.first, self.window = words.first, window
        self.words = words.hashes()
        n, short = len(self.words), window - minimizer + 1
        counts = np.diff(self.first)
        if n < window:
            self.doc = self.start = self.runs = self.place = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        small = sequence_hash(self.words, minimizer)
        least = _leftmost_least(small, short)
        doc = np.repeat(np.arange(len(counts)), counts)[:len(least)]
        good = np.arange(len(least)) + window <= self.first[doc + 1]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~good[:-1]
        self.start = np.flatnonzero(new & good)
        ends = np.searchsorted(np.flatnonzero(new | ~good), self.start, side="right")
        bounds = np.append(np.flatnonzero(new | ~good), len(least))
        self.runs = bounds[ends] - self.start
        self.doc, self.place = doc[self.start], least[self.start]
        self.hash = small[self.place]

    def contents(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each chosen segment: all its words and where the minimizer stands in it."""
        out = []
        for k, base in enumerate((BASE, OTHER)):
            n = len(self.words)
            power, back = _powers(base, n + 1), _powers(np.uint64(pow(int(base), -1, 1 << 64)), n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(self.words + np.uint64(k)) * power[:n], out=total[1:])
            a = self.start[which]
            b = a + self.runs[which] + self.window - 1
            where = (self.place[which] - a).astype(np.uint64) * np.uint64(1 << 32) + (b - a).astype(np.uint64)
            out.append(mix((total[b] - total[a]) * back[a] + mix(where)))
        return out[0], out[1]

    def run_hashes(self) -> np.ndarray:
        return sequence_hash(self.words, self.window, seed=3)


def _anchors(window: int, minimizer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column("text"), SLICE):
                s = Segments(raw, offsets, window, minimizer)
                rows = pa.array(s.doc)
                yield pa.record_batch([pa.array(s.hash.view(np.int64)), batch.column("id").slice(a, b - a).take(rows),
                                       batch.column("same").slice(a, b - a).take(rows),
                                       pa.array((s.start - s.first[s.doc]).astype(np.int32))],
                                      ["mark", "id", "same", "start"])
    return run


def _segments(window: int, minimizer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("starts")
            for a, b, raw, offsets in slices(batch.column("text"), SLICE):
                s = Segments(raw, offsets, window, minimizer)
                mine = starts.slice(a, b - a)
                wanted = np.repeat(s.first[:-1], np.asarray(pa.compute.list_value_length(mine)))
                wanted = wanted + np.asarray(mine.flatten())
                which = np.flatnonzero(np.isin(s.start, wanted))
                if not len(which):
                    continue
                one, two = s.contents(which)
                runs = s.run_hashes()
                bounds = np.zeros(len(which) + 1, np.int32)
                np.cumsum(s.runs[which], out=bounds[1:])
                inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], s.runs[which]) + np.repeat(s.start[which], s.runs[which])
                rows = pa.array(s.doc[which])
                yield pa.record_batch(
                    [batch.column("id").slice(a, b - a).take(rows), batch.column("same").slice(a, b - a).take(rows),
                     pa.array((s.start - s.first[s.doc])[which].astype(np.int32)), pa.array(s.runs[which].astype(np.int32)),
                     pa.array(s.hash[which].view(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(runs[inside].view(np.int64)))],
                    ["id", "same", "start", "runs", "mark", "one", "two", "hashes"])
    return run


def _rows(docs: DataFrame) -> DataFrame:
    """id and same tell rows apart, but for rows of equal id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                       F.xxhash64(text, F.col("doc_id").isNull()).alias("same"), text.alias("text"))


def repeated_segments(rows: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """Segments of the documents at minimizers that occur more than once."""
    anchors = rows.select("id", "same", "text").mapInArrow(
        _anchors(window, minimizer), "mark long, id long, same long, start int")
    twice = written(anchors.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "marks")
    starts = anchors.join(twice, "mark").groupBy("id", "same").agg(F.collect_set("start").alias("starts"))
    return written(rows.select("id", "same", "text").join(starts, ["id", "same"]).mapInArrow(
        _segments(window, minimizer),
        "id long, same long, start int, runs int, mark long, one long, two long, hashes array<long>"), "segments")


def partly_repeated(kinds: DataFrame) -> DataFrame:
    """one, two, at: runs, by place, of segments that occur once but share runs with other segments.

    `kinds` has one row for each content of a segment, with `n`, how often it occurs.
    """
    several = kinds.groupBy("mark").agg(F.count("*").alias("contents")).filter("contents > 1").select("mark")
    runs = written(kinds.join(several, "mark").select(
        "mark", "one", "two", "n", F.posexplode("hashes").alias("at", "hash")), "runs")
    shared = written(runs.groupBy("mark", "hash").agg(F.sum("n").alias("times")).filter("times > 1")
                     .select("mark", "hash"), "shared-runs")
    return runs.filter("n = 1").join(shared, ["mark", "hash"]).groupBy("one", "two").agg(
        F.array_sort(F.collect_list("at")).alias("places"))


def compacted(segments: DataFrame, kinds: DataFrame) -> DataFrame:
    """one, two, path, offset: the path that each repeated segment lies on and how many runs it stands from its head.

    A link from one segment to the next is kept if nothing else follows the one or comes before the other;
    heads are then found by pointer doubling. Segments on a ring without a head are paths of their own.
    """
    key = F.struct("one", "two")
    repeated = kinds.filter("n > 1").select(key.alias("s"), "runs")
    places = Window.partitionBy("id", "same").orderBy("start")
    pairs = segments.select(key.alias("s"), F.lead(key).over(places).alias("next"),
                            (F.lead("start").over(places) == F.col("start") + F.col("runs")).alias("touch"))
    pairs = written(pairs.groupBy("s", F.when(F.col("touch"), F.col("next")).alias("next")).agg(
        F.count("*").alias("n")), "pairs")
    # A document's end after a segment counts as a branch too: spans there end as well.
    after = pairs.groupBy("s").agg(F.count("*").alias("ways"), F.first("next").alias("next")).filter("ways = 1")
    before = pairs.filter("next IS NOT NULL").groupBy("next").agg(F.count("*").alias("ways")).filter("ways = 1")
    links = after.filter("next IS NOT NULL").join(before.select("next"), "next").select(
        F.col("next").alias("s"), F.col("s").alias("back")).filter("s <> back")
    state = repeated.join(links.join(repeated.select(F.col("s").alias("back"), F.col("runs").alias("skip")), "back"),
                          "s", "left").select("s", "back", F.coalesce("skip", F.lit(0)).cast("long").alias("offset"))
    state = written(state, "links")
    done = [state.filter("back IS NULL").select("s", F.col("s").alias("path"), "offset")]
    heads = done[0]
    active = state.filter("back IS NOT NULL")
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        # Those that point at a finished segment are finished; the others look twice as far back.
        over = active.join(heads.select(F.col("s").alias("back"), "path", F.col("offset").alias("more")), "back")
        over = written(over.select("s", "path", (F.col("offset") + F.col("more")).alias("offset")), "heads")
        waiting = active.join(over.select("s"), "s", "left_anti")
        hop = active.select(F.col("s").alias("back"), F.col("back").alias("further"), F.col("offset").alias("more"))
        active = written(waiting.join(hop, "back").select(
            "s", F.col("further").alias("back"), (F.col("offset") + F.col("more")).alias("offset")), "pointers")
        done.append(over)
        heads = heads.unionAll(over)
        if active.isEmpty():
            break
    rings = active.select("s", F.col("s").alias("path"), F.lit(0).cast("long").alias("offset"))
    return heads.unionAll(rings).select("s.one", "s.two", F.xxhash64("path").alias("path"), "offset")


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """id, same, start, end (words, end exclusive) of passages made of repeated runs."""
    segments = repeated_segments(_rows(docs), window, minimizer)
    kinds = written(segments.groupBy("one", "two").agg(
        F.count("*").alias("n"), F.first("mark").alias("mark"), F.first("runs").alias("runs"),
        F.first("hashes").alias("hashes")), "kinds")
    plain = segments.drop("hashes")
    paths = written(compacted(plain, kinds), "paths")
    whole = plain.join(paths, ["one", "two"]).groupBy("id", "same", "path", (F.col("start") - F.col("offset")).alias("at"))
    whole = whole.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("runs")).alias("stop"))
    part = plain.join(written(partly_repeated(kinds), "partly"), ["one", "two"]).select(
        "id", "same", F.explode("places").alias("at"), "start")
    part = part.select("id", "same", (F.col("start") + F.col("at")).alias("start"))
    return whole.select("id", "same", "start", (F.col("stop") + window - 1).alias("end")).unionAll(
        part.select("id", "same", "start", (F.col("start") + window).alias("end")))


def _remove(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if spans.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    for s in spans.as_py():
                        change[s["start"]] += 1
                        change[s["end"]] -= 1
                    stay = np.cumsum(change)[:-1] == 0
                    words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
                removed.append(total[-1] - len(words))
                data = b" ".join(words)
                kept.append(hashlib.sha256(data).hexdigest() if digest else data.decode("utf-8", "surrogatepass"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                   pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept"])
    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the remaining words joined by spaces, or their SHA-256."""
    spans = repeated_spans(docs, window, minimizer).groupBy("id", "same").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = _rows(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(spans, ["id", "same"], "left").select("doc_id", "text", "spans").mapInArrow(
        _remove(digest), f"doc_id {kind}, n_words long, n_removed long, kept string")
