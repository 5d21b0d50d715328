"""License notices, ranked by how much a template helps to compress a block.

A text is read across its line breaks: what stands before the first word of a line (comment markers) and
markers at its end are passed over, runs of blanks count as one. Blocks are the surroundings of cue words of
license texts, twice the longest template to either side; long ones are cut into overlapping windows that hold any
notice whole. Each block is compressed alone and with every template as a raw zstandard dictionary; the
template that saves most bytes wins. A win is confirmed by exact wording: words of block and template are
aligned around their longest common run, and the words missing, added or replaced must be at most `allowed` of the
template's. What is left of the block before and after a notice is ranked again, until no template is confirmed.
Places are those of the original text.

Documents without a cue never leave the JVM filter; the others are worked on row by row in tasks, nothing
shuffles. Null and empty texts give no rows; repeated rows give repeated results; of equal savings
the first template by name wins. doc_id is passed through.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common notices of well-known licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction'),
}
CUE = r"(?i)licen[cs]e|copyright|permission|redistribut"
LEVEL = 3
ALLOWED = 0.2
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


LINE = re.compile(r"[^\n\r\v\f\x1c-\x1e\x85\u2028\u2029]+")
# Before the first word of a line nothing is read, nor a comment marker that is a word.
LEAD = re.compile(r"(?i)(?:[\W_]++|(?:dnl|rem)(?=\s))*+")
PIECE = re.compile(r"\S++(?:\s\S++)*+")


class Flat:
    """A text on one line, and the place in the original of every place in it."""

    def __init__(self, text: str):
        pieces, self.there, self.here, at = [], [], [], 0
        for line in LINE.finditer(text):
            begin = LEAD.match(text, line.start(), line.end()).end()
            end = begin + len(text[begin:line.end()].rstrip(" \t*#/|"))
            for piece in PIECE.finditer(text, begin, end):
                pieces.append(piece[0])
                self.there.append(piece.start())
                self.here.append(at)
                at += len(piece[0]) + 1
        self.text = " ".join(pieces)

    def original(self, place: int) -> int:
        k = bisect_right(self.here, place) - 1
        return self.there[k] + place - self.here[k]


def blocks(text: str, longest: int) -> Iterator[tuple[int, str]]:
    """(place, block) around cues; windows of 4 * longest step by half their length."""
    cue, size, reach = re.compile(CUE), 4 * longest, []
    for m in cue.finditer(text):
        begin, end = max(0, m.start() - size // 2), m.end() + size // 2
        if reach and begin <= reach[-1][1]:
            reach[-1][1] = end
        else:
            reach.append([begin, end])
    for begin, end in reach:
        end = min(end, len(text))
        for k in range(begin, max(begin + 1, end - size // 2), size // 2):
            part = text[k:min(k + size, end)]
            if cue.search(part):
                yield k, part


class Scanner:
    def __init__(self, templates: dict[str, str], level: int = LEVEL):
        self.templates = dict(sorted(templates.items()))
        self.alone = zstandard.ZstdCompressor(level=level)
        self.with_template = {name: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(
            text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, text in self.templates.items()}
        self.words = {name: [w.lower() for w in WORD.findall(text)] for name, text in self.templates.items()}
        self.longest = max(map(len, templates.values()))
        self.cue = re.compile(CUE)

    def savings(self, block: str) -> list[tuple[int, str]]:
        """(bytes saved, template), best first."""
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.alone.compress(data))
        return sorted(((alone - len(c.compress(data)), name) for name, c in self.with_template.items()),
                      key=lambda x: (-x[0], x[1]))

    def wording(self, block: str, name: str, allowed: float) -> tuple[int, int, list[str], list[str]] | None:
        """Start, end, words missing and words added of a confirmed alignment.

        With d differences some run of the template's words is whole and at least (n - d) / (d + 1) long.
        The longest common run is taken first; if no notice stands around it, one may stand beside it.
        """
        found = list(WORD.finditer(block))
        words, want = [m[0].lower() for m in found], self.words[name]
        most = int(allowed * len(want))
        least = max(1, -(-(len(want) - most) // (most + 1)))
        match = difflib.SequenceMatcher(None, want, words, autojunk=False)
        parts = [(0, len(words))]
        while parts:
            lo, hi = parts.pop()
            run = match.find_longest_match(0, len(want), lo, hi)
            if run.size < least:
                continue
            begin, end = max(lo, run.b - run.a - most), min(hi, run.b + len(want) - run.a + most)
            first, last, missing, added = self.aligned(want, words[begin:end])
            if len(missing) + len(added) <= allowed * len(want):
                return found[begin + first].start(), found[begin + last].end(), missing, added
            parts += [(run.b + run.size, hi), (lo, run.b)]
        return None

    @staticmethod
    def aligned(want: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]]:
        """First and last word, words missing and added; matches far out that cost more than they give are left."""
        same = [m for m in difflib.SequenceMatcher(None, want, words, autojunk=False).get_matching_blocks() if m.size]
        top = max(range(len(same)), key=lambda i: same[i].size)

        def outward(order: list[int]) -> int:
            best, gain, least = order[0], 0, 0
            for i, j in zip(order, order[1:], strict=False):
                x, y = same[min(i, j)], same[max(i, j)]
                gain += y.b - x.b - x.size - same[j].size
                if gain < least:
                    best, least = j, gain
            return best
        i, j = outward(list(range(top, -1, -1))), outward(list(range(top, len(same))))
        first, last = same[i], same[j]
        missing, added = want[:first.a], []
        for x, y in zip(same[i:j], same[i + 1:j + 1], strict=True):
            missing += want[x.a + x.size:y.a]
            added += words[x.b + x.size:y.b]
        return first.b, last.b + last.size - 1, missing + want[last.a + last.size:], added

    def notices(self, block: str, allowed: float) -> Iterator[tuple]:
        """Start, end, template, bytes saved on the notice itself, words missing and added, of every notice.

        What stands before and after a notice is ranked again.
        """
        parts = [(0, len(block))]
        while parts:
            lo, hi = parts.pop()
            part = block[lo:hi]
            if not self.cue.search(part):
                continue
            for _, name in self.savings(part):
                aligned = self.wording(part, name, allowed)
                if aligned:
                    start, end, missing, added = aligned
                    yield lo + start, lo + end, name, dict((n, x) for x, n in self.savings(part[start:end]))[name], missing, added
                    parts += [(lo + end, hi), (lo, lo + start)]
                    break

    def scan(self, text: str, allowed: float) -> Iterator[tuple]:
        """Overlapping windows see a notice twice, or a part of it: of overlapping spans the one with most of its template stays."""
        flat = Flat(text)
        found = {(at + hit[0], at + hit[1], *hit[2:4], tuple(hit[4]), tuple(hit[5]))
                 for at, block in blocks(flat.text, self.longest) for hit in self.notices(block, allowed)}
        kept: list[tuple] = []
        for hit in sorted(found, key=lambda h: (len(h[4]) + len(h[5]) - len(self.words[h[2]]), h)):
            k = bisect_right(kept, hit[0], key=lambda h: h[0])
            if (not k or kept[k - 1][1] <= hit[0]) and (k == len(kept) or hit[1] <= kept[k][0]):
                kept.insert(k, hit)
        for start, end, name, saved, missing, added in kept:
            yield flat.original(start), flat.original(end - 1) + 1, name, saved, list(missing), list(added)


def license_notices(docs: DataFrame, templates: dict[str, str] | None = None, allowed: float = ALLOWED) -> DataFrame:
    """One row per confirmed notice: place, template, bytes saved and the wording differences."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                    for hit in scanner.scan(text.as_py(), allowed)]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(),
                         pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                      ["doc_id", "start", "end", "license", "saved", "missing", "added"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter(F.col("text").rlike(CUE)).select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, end long, license string, saved long, missing array<string>, added array<string>")
