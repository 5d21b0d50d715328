"""Fill-in-middle, the prefix trie and the vector index against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm import fill_middle, pivot_index, prefix_trie
from llm.rank_index import ERROR, RankIndex, code_points


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Rank index

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=300), st.sampled_from([0, 3, ERROR]))
def test_every_place_is_exact(steps, error):
    at = np.concatenate([[5], 5 + np.cumsum(steps)]).astype(np.int64) if steps else np.array([5], np.int64)
    index = RankIndex(error)
    index.add(at[:len(at) // 2])
    index.add(at[len(at) // 2:])
    index.finish()
    assert index.locate(np.arange(len(at))).tolist() == at.tolist()
    assert np.abs(index.residual.astype(int)).max() <= error + 1


def test_segments_are_few_on_text():
    text = "é東a😀 plain words and ß " * 20000 + "x" * 300_000 + "日本" * 100_000
    raw = np.frombuffer(text.encode(), np.uint8)
    index = code_points(raw, piece=70_001)
    want = np.cumsum([0] + [len(c.encode()) for c in text])
    assert (index.locate(np.arange(len(text) + 1)) == want).all()
    assert len(index.begins) < 60


# Fill-in-middle

def brute_middle(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc, n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    r = random.Random(3)
    alphabet = "ab <>PSM\n\té東😀"
    out = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(120)]
    return out + [None, "", "x", "😀", "<P", "a<M>b", "<S>", "é" * 5000, "日本 語" * 400_000 + "z" * 700_000, " " * 2_000_000]


def test_cuts(spark, docs, rows):
    more = [(5000 + i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (None, None)]
    more += more[:3]
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string").repartition(3))
    made = fill_middle.rearrange(both).withColumn("whole", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    data = [r[:2] for r in rows] + more
    assert Counter(tuple(r)[:6] for r in made) == Counter(brute_middle(*d) for d in data)
    texts = defaultdict(set)
    for doc, text in data:
        texts[doc].add(text or "")
    assert all(r.whole in texts[r.doc_id] for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_cuts_of_odd_tables(spark, empty, clashing, rows):
    assert fill_middle.rearrange(empty).collect() == []
    got = fill_middle.rearrange(clashing.select("*", F.lit(1).alias("n"), F.lit(2).alias("form")), carry=("doc_id", "lang"))
    assert got.columns == ["doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert Counter((r.doc_id, r.lang, r.output) for r in got.collect()) == Counter(
        (r[0], r[2], brute_middle(r[0], r[1])[5]) for r in rows)


# Prefix trie

def brute_trie(data):
    order = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            order[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in order.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, s in whole.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        own = (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not children[k]
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    sha(",".join(map(str, sorted(ends[k]))))) for k, m in members.items())


def talk(r, convs):
    out = []
    for c in range(convs):
        if c in (40, 60):
            continue            # families without their first conversation
        size = r.choice([1, 1, 2, 3, 4, 6])
        hot = r.random() < 0.4
        for turn in range(size):
            text = "the same opening  line" if hot or turn == 0 else r.choice(["yes", "no\tand more", "", None, "one two three"])
            out.append((c, turn, "user" if turn % 2 == 0 else "assistant", text))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TALK = "conv_id long, turn long, role string, text string"


def trie(df, **kw):
    return Counter(map(tuple, prefix_trie.prefix_trie(df, **kw).select(*COLUMNS).collect()))


@pytest.mark.parametrize("piece", [1, 4096])
def test_trie(spark, piece):
    data = talk(random.Random(5), 130)
    data += [(7, None, "system", "null first"), (7, None, "system", "a second null"), (8, 1, "user", "same number"), (8, 1, None, "same number"),
             (9, 0, "user", "again"), (9, 0, "user", "again"), (None, 0, "user", "no id"), (-5, 0, None, None), (-25, 3, "x", "y z"),
             (61, 0, "user", "turnless if its head is one")]
    df = spark.createDataFrame(data, TALK).repartition(5)
    assert trie(df, piece=piece) == brute_trie(data)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("node", "leaf", "digest", "words", "depth", "place")])
    assert trie(clash) == brute_trie(data)


def test_long_and_empty_conversations(spark):
    other = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 0)
    data = [(20, t, "user", f"word {t}") for t in range(3000)] + [(21, t, "user", f"word {t}") for t in range(2000)]
    data += [(other, 0, "a", "b " * 300_000)]
    rows = prefix_trie.prefix_trie(spark.createDataFrame(data, TALK)).select(*COLUMNS).collect()
    assert len(rows) == 3002 and max(r.depth for r in rows) == 3000
    root = next(r for r in rows if r.depth == 0)
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (3, 2, 2, 4000)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALK)).collect() == []


def test_only_turnless(spark):
    head = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 >= 1)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(head, 0, "u", "t")], TALK)).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == [(head, 0, None, 1, 0, 1, 0, sha(str(head)))]


# Vector index

def crowd(r, size=48):
    """Lone vectors, loose pairs around the threshold, a crowd of near copies, exact copies, and rows that take no part."""
    lone = r.normal(size=(400, size))
    def near(v, c):
        v = v / np.linalg.norm(v)
        z = r.normal(size=size)
        z -= (z @ v) * v
        return (c * v + np.sqrt(1 - c * c) * z / np.linalg.norm(z)) * r.uniform(0.1, 9)
    pairs = [near(v, c) for v, c in zip(lone[:200], np.linspace(0.84, 0.999, 200), strict=True)]
    centre = r.normal(size=size)
    many = [near(centre, r.uniform(0.93, 0.99)) for _ in range(150)]
    vectors = [v.tolist() for v in [*lone, *pairs, *many]]
    vectors += [vectors[3]] * 40 + [vectors[620]] * 30
    vectors += [None, [], [0.0] * size, [float("nan")] + [1.0] * (size - 1), [float("inf")] + [1.0] * (size - 1),
                [None] + [1.0] * (size - 1), [1e-300] * size, [1e300] * size, [1.0] * 5, [1.0, 1.0, 1.0, 1.0, 1.1], [2.0], [-3.0], [4.0]]
    return vectors


def brute_links(vectors, threshold=0.9):
    links = set()
    units = []
    for v in vectors:
        ok = v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0
        u = np.array(v) / np.abs(v).max() if ok else None
        units.append(u / np.linalg.norm(u) if ok else None)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links.add((j, i))
    return links


def components_of(links, size):
    root = list(range(size))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(x) for x in range(size)]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors(spark, block):
    vectors = crowd(np.random.default_rng(8))
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, vector array<double>").repartition(4)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("node", "size", "key", "label")])
    got = {r.vec_id: r for r in pivot_index.near_duplicates(df, block=block).collect()}
    links = brute_links(vectors)
    degree = Counter(x for link in links for x in link)
    assert len(got) == len(vectors)
    assert all(got[i].n_links <= degree[i] for i in got)                        # none below the threshold
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(degree.values())  # recall
    # Every pair that shares enough pivots is found, so on links all found the components are exact.
    if all(got[i].n_links == degree[i] for i in got):
        assert [got[i].component_id for i in range(len(vectors))] == components_of(links, len(vectors))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert {got[i].component_id for i in range(600, 750)} == {min(i for i in range(600, 750))}
    assert [got[len(vectors) - k].n_links for k in (1, 2, 3)] == [1, 0, 1]


def test_recall_at_the_threshold():
    """Pairs at exactly 0.9, the hardest, in an index of the size of ten thousand rows."""
    r = np.random.default_rng(2)
    sample = r.normal(size=(4000, 64))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    pivots = pivot_index.choose_pivots(sample, pivot_index.pivot_number(10_000), 0.8)
    z = r.normal(size=sample.shape)
    z -= (z * sample).sum(axis=1)[:, None] * sample
    other = 0.9 * sample + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1)[:, None]
    prefix = pivot_index.prefix_length(len(pivots))
    a, b = (pivot_index.nearest_pivots(v, pivots, prefix) for v in (sample, other))
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
    assert (shared >= pivot_index.SHARED).mean() >= 0.9


def test_vector_tables_without_links(spark):
    shape = "vec_id long, vector array<float>"
    assert pivot_index.near_duplicates(spark.createDataFrame([], shape)).collect() == []
    data = [(1, None), (2, [0.0]), (None, [1.0, 2.0]), (None, None), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [-1.0, 5.0])]
    got = pivot_index.near_duplicates(spark.createDataFrame(data, shape)).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True), (None, 0, None, True),
                                                (4, 1, 4, True), (4, 1, 4, True), (4, 0, 4, True)])
