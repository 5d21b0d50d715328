"""Operators on documents against brute force in plain Python."""

import hashlib
import os
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import bloom, exact_dedup, jaccard_join, licenses, line_dedup, mixing, packing, pii, sketch, substring_dedup
from llm.components import components
from llm.queries import tokenizer_files
from llm.words import Words

SPACE = "[\x20\x09-\x0d]"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


# Exact dedup

def want_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    return [(r[0], max(groups[t]), len(groups[t]), r[0] == max(groups[t]), sha(t)) for r in rows for t in [lower(r[1])]]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_copies(docs, rows, bits):
    got = exact_dedup.exact_duplicates(docs, exact_dedup.chunk_pattern(20, 90), bits)
    same(got.collect(), want_copies(rows))


def test_exact_copies_of_long_texts(spark):
    text = ("word, " * 3000) + "end."
    data = [(1, text), (2, text.upper()), (3, text + "x"), (None, text)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {
        (1, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True), (None, 2, 3, False)}


# Line dedup

def want_lines(rows):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return out


@pytest.mark.parametrize("largest", [line_dedup.LARGEST_FILTER, 512])
def test_lines(docs, rows, largest):
    got = line_dedup.drop_repeated_lines(docs, largest=largest, digest=True)
    same(got.select("doc_id", "n_lines", "n_dropped", "kept").collect(), want_lines(rows))


def test_lines_as_text_and_without_id(spark):
    data = [(None, "same line here\nx"), (2, "same line here"), (1, "Same line HERE \nown line of one")]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept) for r in got} == {
        (None, "same line here\nx"), (2, ""), (1, "Same line HERE \nown line of one")}


# Substring dedup

def want_passages(rows, window):
    seen = Counter()
    for _, text, *_ in rows:
        w = words_of(text)
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for doc, text, *_ in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


@pytest.mark.parametrize(("window", "minimizer"), [(35, 8), (12, 3)])
def test_passages(docs, rows, window, minimizer):
    got = substring_dedup.remove_repeated(docs, window, minimizer, digest=True)
    same(got.collect(), want_passages(rows, window))


# Jaccard join

def want_classes(rows, width, num, den):
    sets = []
    for _, text, *_ in rows:
        w = words_of(lower(text))
        sets.append({tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("width", "num", "block"), [(3, 90, 2048), (5, 80, 2048), (3, 60, 2)])
def test_classes(docs, rows, width, num, block, monkeypatch):
    if block == 2:  # every region is divided around pivots and then joined in blocks
        monkeypatch.setattr(jaccard_join, "LARGE", 1)
    got = jaccard_join.jaccard_classes(docs, width, num, 100, block=block)
    same(got.collect(), want_classes(rows, width, num, 100))


def test_one_of_each_class(docs, rows):
    carry = ["doc_id", "text", "lang", "source", "n_chars"]
    got = jaccard_join.first_of_class(docs, 5, 80, 100, carry).collect()
    want = {a for a, _, c in want_classes(rows, 5, 80, 100) if a == c}
    assert Counter(r.doc_id for r in got) == Counter(want)


def test_one_row_of_each_class_under_repeated_ids(spark):
    one, two, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "bac")
    data = [(7, one), (9, one + " more"), (7, two), (3, two + " more"), (5, other), (5, "quite unlike " + one.upper()[:40]),
            (5, other), (8, None), (8, " ")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = jaccard_join.first_of_class(docs, 5, 80, 100, ["doc_id", "text"]).collect()
    assert Counter(map(tuple, got)) == Counter([data[0], data[3], data[4], data[5], data[7], data[8]])


def test_rows_without_id_stay(spark):
    text = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(None, text), (None, text), (4, text), (3, text + " more"), (9, None)], "doc_id long, text string")
    assert Counter(r.doc_id for r in jaccard_join.first_of_class(docs, 5, 80, 100, ["doc_id", "text"]).collect()) == Counter(
        [None, None, 3, 9])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# Personal data

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = ["a@b.c_d@e.f and é x.y+z@q-1.example.org.", "1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.255", "4337166598464399 4337 1665 9846 4399 12",
       "+1 (906) 555-7738 +44 20 7946 0958) +12", "@@ a@b a@b.c@d.e", "9" * 400, "a" * 3000 + "@x.yz", "+" * 50 + "1", None, ""]


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1])))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans(spark, rows):
    texts = ODD + [r[1] for r in rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.personal_data(docs).collect()}
    want = {i: [(k, m.start(), m.end()) for k in FORMS for m in re.finditer(FORMS[k], t or "") if fits(k, m[0])]
            for i, t in enumerate(texts)}
    assert got == want


def test_patterns_find_more(spark):
    known = [f"please call me at +1 (906) 555-{1000 + i} soon" for i in range(8)]
    docs = spark.createDataFrame(list(enumerate([*known, "please call me at 0906555123, soon", "batch number is 12345678"])),
                                 "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r["all"]] for r in pii.personal_data(docs).collect()}
    assert got[8] == [("phone", 18, 28)] and got[9] == [] and len(got[0]) == 1


def test_patterns_find_spaced_forms(spark):
    texts = [f"please call me at +1 (906) 555-{1000 + i} soon" for i in range(20)]
    texts += [f"my mail is user{i}@example.org today" for i in range(20)]
    more = [("please call me at ", "030 901 8200", ", soon"), ("my mail is ", "anna (at) example.org", " today"),
            ("my mail is ", "bob [at] example [dot] org", ""), ("please call me at ", "123", " then")]
    docs = spark.createDataFrame(list(enumerate([*texts, *map("".join, more), "batch number is 12 34 56"])), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r["all"]] for r in pii.personal_data(docs).collect()}
    for i, (a, b, _) in enumerate(more):
        assert got[40 + i] == [("email" if "mail" in a else "phone", len(a), len(a) + len(b))]
    assert got[44] == []


# License notices

def test_notices(spark):
    t = licenses.TEMPLATES
    texts = [f"x\n{t['mit']}\ny", "Released under the MIT-0 License.", "A license to dream.", None, "",
             "pad " * 900 + t["gpl-3.0"] + " tail" * 900, t["apache-2.0"] + "\n" + t["cc-by-nc-4.0"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license, texts[r.doc_id][r.start:r.end], tuple(r.missing), tuple(r.added))
           for r in licenses.license_notices(docs).collect()}
    assert {g[:2] for g in got if not g[3] and not g[4]} == {(0, "mit"), (5, "gpl-3.0"), (6, "apache-2.0"), (6, "cc-by-nc-4.0")}
    assert not [g for g in got if g[0] in (2, 3, 4)]
    assert (0, "mit", "Released under the MIT License", (), ()) in got


@pytest.mark.parametrize("between", [" ", " and some words more ", " pad" * 400 + " "])
def test_several_notices_on_a_line(spark, between):
    t = licenses.TEMPLATES
    names = ["mit", "cc-by-4.0", "mit", "gpl-3.0", "apache-2.0-notice", "mit-notice", "mit-notice", "mit"]
    docs = spark.createDataFrame([(1, between.join(t[n] for n in names))], "doc_id long, text string")
    got = sorted(licenses.license_notices(docs).collect(), key=lambda r: r.start)
    assert [r.license for r in got] == names and not [r for r in got if r.missing or r.added]


def wrapped(text, marker, width=60):
    return "".join(f"{marker} {line}\n" for line in textwrap.wrap(text, width))


@pytest.mark.parametrize("marker", ["", " *", "#", "//", "dnl", "--"])
def test_wrapped_notices(spark, marker):
    t, names = licenses.TEMPLATES, ["mit-notice", "gpl-3.0-notice", "apache-2.0-notice"]
    texts = [f"{marker} Some program\n{marker}\n" + wrapped(t[n], marker) + "\n\nint main() { return 0; }\n" for n in names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_notices(docs).collect()}
    for i, name in enumerate(names):
        assert (got[i].license, got[i].missing, got[i].added) == (name, [], [])
        mine = texts[i][got[i].start:got[i].end]
        assert mine.split()[0] == t[name].split()[0] and mine.split()[-1] == t[name].split()[-1].rstrip(".")


# Packing

def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files()[0])
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((doc, k, len(ids[k:k + 64]), zlib.crc32(ids[k:k + 64].tobytes()), len(ids)) for k in range(0, len(ids), 64))
    got = packing.pack(docs, *tokenizer_files(), length=64, group=20).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("text", ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "\t" * 2_000_000 + "x", "\u00a0 \n" * 700_000,
                                  "letters" * 150_000], ids=["blanks", "newlines", "tabs", "mixed", "word"])
def test_very_long_runs(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tokenizer_files()[0]).encode(text, add_special_tokens=False).ids
    assert packing.encoder(*tokenizer_files())(text) == want


def test_chance_meetings_do_not_move(spark):
    """Of unrelated texts that share a rare shingle in twos, less than a third goes on; every planted pair does."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, rng.integers(60, 300))) + f" some phrase {i % 200}"
             for i in range(400)]
    texts += [t + " more" for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    late = spark.sparkContext.broadcast(jaccard_join.crowded(docs, 3, 90, 100))
    held = docs.select("text").mapInArrow(jaccard_join._prefixes(3, 90, 100, late), "node long, token long, spot long")
    shared = held.groupBy("token").agg(F.count_distinct("node").alias("n")).filter("n > 1").select("token")
    met = held.join(shared, "token").select("node").distinct().count()
    got = jaccard_join.meetings(held, 90, 100)
    pairs = {tuple(sorted(jaccard_join.digests(s)[0] for s in jaccard_join.shingle_sets(pa.array([a, a + " more"]), 3)))
             for a in texts[:10]}
    nodes = {r.node for r in got.select("node").distinct().collect()}
    assert {x for p in pairs for x in p} <= nodes
    assert len(nodes) - 20 < (met - 20) / 3, (len(nodes), met)


def test_special_token_text():
    encode = packing.encoder(*tokenizer_files())
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_first_fit_decreasing():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 100, 200)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for k in np.argsort(-sizes, kind="stable"):
        b = next((i for i, x in enumerate(room) if x >= sizes[k]), len(room))
        if b == len(room):
            room.append(100)
        assert (bins[k], offsets[k]) == (b, 100 - room[b])
        room[b] -= sizes[k]


# Mixing

def brute_schedule(blocks, weights):
    """Slot by slot: earliest deadline first among released blocks, a new phase when a source ends."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    taken = dict.fromkeys(blocks, 0)
    while left:
        total, start, done = sum(weights[s] for s in left), len(out), dict.fromkeys(left, 0)
        while True:
            ready = [(-(-(done[s] + 1) * total // weights[s]), repr(s), s) for s in left
                     if done[s] < left[s] and done[s] * total // weights[s] <= len(out) - start]
            s = min(ready)[2]
            out.append((s, taken[s]))
            done[s] += 1
            taken[s] += 1
            for x in left:  # less than one block from the share
                assert abs(done[x] - (len(out) - start) * weights[x] / total) < 1
            if done[s] == left[s]:
                break
        left = {x: n - done[x] for x, n in left.items() if n > done[x]}
    return out


def test_schedule():
    blocks, weights = {"sa": 13, "sb": 40, "null": 3, "sc": 0}, {"sa": 3, "sb": 2, "null": 1, "sc": 5}
    want = {x: i for i, x in enumerate(brute_schedule(blocks, weights))}
    got = {}
    for s, n in blocks.items():
        mine = [p for p in mixing.phases(blocks, weights) if p["source"] == s]
        for j in range(n):
            p = [x for x in mine if x["taken"] <= j][-1]
            k, a = j - p["taken"], len(p["offsets"])
            got[s, j] = p["base"] + k // a * p["round"] + p["offsets"][k % a]
    assert got == want


def test_mix(docs, rows):
    got = mixing.mix(docs, {"big": 3}, block=4, bucket=16).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert len({(r.slot, r.position) for r in got}) == len(got)
    sizes = Counter(r[3] for r in rows)
    blocks = {f"s{s}" if s else "null": -(-n // 4) for s, n in sizes.items()}
    order = brute_schedule(blocks, {s: 3 if s == "sbig" else 1 for s in blocks})
    assert {(f"s{r.source}" if r.source else "null", r.block): r.slot for r in got} == {x: i for i, x in enumerate(order)}


# All of them on no rows and with clashing columns

OPERATORS = {
    "exact": exact_dedup.exact_duplicates,
    "lines": line_dedup.drop_repeated_lines,
    "passages": substring_dedup.remove_repeated,
    "classes": lambda d: jaccard_join.jaccard_classes(d, 3, 90, 100),
    "first": lambda d: jaccard_join.first_of_class(d, 5, 80, 100, ["doc_id", "text"]),
    "pii": pii.personal_data,
    "licenses": licenses.license_notices,
    "packing": lambda d: packing.pack(d, *tokenizer_files()),
    "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(clashing, docs, name):
    got, want = OPERATORS[name](clashing), OPERATORS[name](docs)
    assert got.columns == want.columns and got.count() == want.count()


# Helpers

def test_words():
    raw = np.frombuffer("Ab\x0bcd  éf\t".encode() + b"" + b" gh", np.uint8)
    w = Words(raw, np.array([0, 11, 11, len(raw)]))
    assert w.first.tolist() == [0, 3, 3, 4]
    one, two = (Words(np.frombuffer(x, np.uint8), np.array([0, 2])).hashes(True)[0] for x in (b"ab", b"AB"))
    assert one == two == w.hashes(True)[0] != w.hashes()[0]


def test_bloom_filter(spark):
    keys = list(range(0, 90_000, 3))
    data, bits = bloom.build(spark.createDataFrame([(k,) for k in keys], "k long"), len(keys))
    packed = np.frombuffer(data, np.uint8)
    assert bloom.holds(packed, bits, np.array(keys)).all()
    assert bloom.holds(packed, bits, np.arange(10 ** 9, 10 ** 9 + 10_000)).mean() < 0.1


def test_sketch(spark):
    df = spark.createDataFrame([(i % 7,) for i in range(700)], "k long").repartition(3)
    table = sketch.counts(df, lambda b: b.column(0).to_numpy().astype(np.uint64) << np.uint64(20))
    assert table.sum() == 700 and table[sketch.cell(np.arange(7, dtype=np.uint64) << np.uint64(20))].tolist() == [100] * 7


def test_regions_tied_by_chance_stay_apart(spark):
    """One region of a long chain would be dealt to many blocks, each set to all of them; small regions that share sets become one."""
    chain = [(i, i + k, 400_000) for i in range(20) for k in (0, 1)]
    small = [(100, 100, 10), (100, 101, 10), (101, 101, 10), (101, 102, 10)]
    members = spark.createDataFrame(chain + small, "region long, node long, n_shingles long")
    got = jaccard_join.merged(members)
    assert sorted(r["node"] for r in got.filter("node >= 100").collect()) == [100, 101, 102]
    assert got.filter("node >= 100").select("region").distinct().count() == 1
    assert sorted((r["region"], r["node"], r["n_shingles"]) for r in got.filter("node < 100").collect()) == sorted(chain)
    assert jaccard_join.blocked(got, jaccard_join.BLOCK, "n_shingles", jaccard_join.BLOCK_SHINGLES).count() == len(chain) + 3


def test_scratch_tables_of_the_join_are_removed(spark, monkeypatch):
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k", "one two three four five six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {}
    real = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: made.setdefault(name, real(df, name)))
    classes = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_classes(docs, 3, 80, 100).collect()}
    assert classes == {0: 0, 1: 0, 2: 2}
    for name in ("prefixes", "shared", "texts"):
        assert not any(os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in made[name].inputFiles()), name
