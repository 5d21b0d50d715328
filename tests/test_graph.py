"""Links, similarity join, network walk, search and screening against plain Python."""

import datetime as dt
import random
from collections import deque
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casetrail.functions.trigrams import Threshold, trigrams
from casetrail.operators import links, network, search, similarity
from casetrail.operators.screen import list_entries, screen, screen_folds

T0 = dt.datetime(2024, 1, 1)


def test_fold(spark):
    rows = [(f"L{n:07d}", T0 + dt.timedelta(hours=(n * 7) % 25), "A1", "D1", True, n) for n in range(25)]
    rows.append(("L9999999", T0, "A1", "D2", False, 99))
    logins = spark.createDataFrame(rows, "event_id string, ts timestamp, account_id string, device_id string, "
                                         "success boolean, arrival bigint")
    (link,) = links.fold_links(links.login_events(logins)).collect()
    assert link.weight == 25 and link.total_zar is None and link.score is None
    assert link.evidence_ids == [f"L{n:07d}" for n in range(20)]
    assert (link.first_seen, link.last_seen) == (T0, T0 + dt.timedelta(hours=24))


def test_folding_in_parts_is_folding_at_once(spark):
    rng = random.Random(3)
    rows = [(f"T{n:07d}", T0 + dt.timedelta(minutes=rng.randint(0, 999)), f"A{rng.randint(1, 3)}",
             f"B{rng.randint(1, 3)}", Decimal(rng.randint(1, 9999)) / 100, n) for n in range(300)]
    txns = spark.createDataFrame(rows, "txn_id string, ts timestamp, from_account string, to_account string, "
                                       "amount_zar decimal(14,2), arrival bigint")
    events = links.transfer_events(txns)
    whole = links.fold_links(events).collect()
    parts = [links.fold_events(events.filter((F.col("arrival") >= 100 * n) & (F.col("arrival") < 100 * n + 100)), n)
             for n in range(3)]
    merged = links.as_links(links.merge_folds(links.merge_folds(parts[0].unionByName(parts[1])).unionByName(parts[2])))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, merged.collect()))


@pytest.mark.parametrize("num,den", [(3, 10), (3, 5), (4, 5)])
def test_similarity_join_misses_nobody(spark, num, den):
    rng = random.Random(num)
    names = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(3, 9))).strip() for _ in range(120)} - {""})
    names = [" ".join(n.split()) for n in names]
    df = similarity.with_codes(spark.createDataFrame([(n,) for n in set(names)], "name string"), "name")
    pairs = similarity.similarity_join(df, df, Threshold(num, den), ["name"], ["name"])
    got = sorted((r.l_name, r.r_name, r.common, r.total) for r in pairs.collect())
    want = []
    listed = spark.createDataFrame([(n,) for n in set(names)], "name string")
    held = {r[0]: set(r[1]) for r in listed.select("name", trigrams(F.col("name"))).collect()}
    for a in set(names):
        for b in set(names):
            ga, gb = held[a], held[b]
            if len(ga & gb) * den >= len(ga | gb) * num:
                want.append((a, b, len(ga & gb), len(ga | gb)))
    assert got == sorted(want)


LINK = ("src string, dst string, kind string, weight bigint, total_zar decimal(16,2), score double, "
        "first_seen timestamp, last_seen timestamp, evidence_ids array<string>")


def random_links(seed, nodes, count):
    rng, out = random.Random(seed), {}
    for _ in range(count):
        kind = rng.choice(["SENT_TO", "OWNS", "LOGGED_IN_FROM"])
        src, dst = rng.sample(range(nodes), 2)
        src = 0 if rng.random() < 0.3 and dst else src   # one hub
        money = Decimal(rng.randint(1, 50)) if kind == "SENT_TO" else None
        out[(f"account:A{src:03d}", f"account:A{dst:03d}", kind)] = (
            rng.randint(1, 4), money, None, T0, T0, [f"T{n:07d}" for n in range(7)])
    return [(*k, *v) for k, v in out.items()]


def plain_walk(rows, center, depth, per_node, max_nodes):
    def order(r):
        return (r[2] not in links.IDENTITY_KINDS, -r[3], r[4] is None, -(r[4] or 0), r[2], r[0], r[1])

    seen, edges, queue, cut = [center], {}, deque([(center, 0)]), False
    while queue:
        at, d = queue.popleft()
        if d >= depth:
            continue
        near = sorted((r for r in rows if at in r[:2]), key=order)
        cut = cut or len(near) > per_node
        for r in near[:per_node]:
            edges[r[:3]] = r
            other = r[1] if r[0] == at else r[0]
            if other not in seen:
                if len(seen) >= max_nodes:
                    cut = True
                    continue
                seen.append(other)
                queue.append((other, d + 1))
    return sorted(seen), sorted(k for k in edges if k[0] in seen and k[1] in seen), cut


@pytest.mark.parametrize("depth,per_node,max_nodes", [(1, 25, 150), (2, 4, 12), (3, 3, 15)])
def test_walk_is_the_queue_walk(spark, depth, per_node, max_nodes):
    rows = random_links(depth, 40, 90)
    table = spark.createDataFrame(rows, LINK)
    centers = sorted({r[0] for r in rows} | {r[1] for r in rows})
    accounts = spark.createDataFrame([("A001", "Anna")], "account_id string, full_name string")
    persons = spark.createDataFrame([], "person_id string, display_name string")
    asked = spark.createDataFrame([(c,) for c in centers] + [("account:none",)], "center string")
    got = {r.center: r for r in network.network(
        table, asked, accounts, persons, depth, per_node=per_node, max_nodes=max_nodes).collect()}
    assert set(got) == set(centers)
    for center in centers:
        nodes, edges, cut = plain_walk(rows, center, depth, per_node, max_nodes)
        row = got[center]
        assert [n.node_id for n in row.nodes] == nodes
        assert sorted((e.src, e.dst, e.kind) for e in row.edges) == edges
        assert row.truncated == cut
        assert all(len(e.evidence_ids) == 5 for e in row.edges)
        assert all(n.label == ("Anna" if n.node_id == "account:A001" else n.node_id[8:]) for n in row.nodes)


def test_walk_bounds_and_kinds(spark):
    rows = random_links(9, 10, 30)
    table, none = spark.createDataFrame(rows, LINK), spark.createDataFrame([], "account_id string, full_name string")
    persons = spark.createDataFrame([], "person_id string, display_name string")
    with pytest.raises(ValueError):
        network.network_of(table, "nonsense", none, persons)
    with pytest.raises(ValueError):
        network.network_of(table, "account:A000", none, persons, depth=4)
    with pytest.raises(ValueError):
        network.network_of(table, "account:A000", none, persons, kinds=["FRIENDS"])
    one = network.network_of(table, "account:A000", none, persons, kinds=["OWNS"]).first()
    assert {e.kind for e in one.edges} == {"OWNS"}


ACCOUNT = ("account_id string, person_id string, full_name string, name_norm string, phone_e164 string, email string, "
           "city string, opened_at timestamp, kyc_evidence_id string, matched_rule string")


def test_search(spark):
    accounts = spark.createDataFrame([
        ("A000001", "P-000001", "Sipho Dlamini", "sipho dlamini", "+27821234567", None, "Soweto", T0, "KYC-000001", "NEW"),
        ("A000002", "P-000001", "Sipho M Dlamini", "sipho m dlamini", "+27821234567", None, "Soweto", T0, "KYC-000002", "R1"),
        ("A000003", "P-000003", "Xu Li", "xu li", "+27821234568", None, "Soweto", T0, "KYC-000003", "NEW")], ACCOUNT)
    listed = list_entries(spark.createDataFrame(
        [("S-083", "Sipho Mandla Dlamini", None, "LIST", ["S Dlamini"])],
        "entry_id string, full_name string, date_of_birth date, list_name string, aliases array<string>"))
    graph = spark.createDataFrame([("account:A000001", "device:D-1a2b3c4d", "LOGGED_IN_FROM", 1, None, None, T0, T0, ["L1"])], LINK)

    def ask(text, limit=10):
        return [(r.node_id, r.score, r.detail) for r in search.search(text, accounts, listed, graph, limit).collect()]

    by_name = ask("Mr Sipho Dlamini")
    assert [h[0] for h in by_name] == ["account:A000001", "account:A000002", "sanction:S-083"]
    assert by_name[0][1] == 1.0 and by_name[0][2] == (
        "owner person:P-000001 | phone +27821234567 | Soweto | opened 2024-01-01 | resolved by NEW")
    assert by_name[2][2] == "LIST entry, date of birth not listed"
    assert [h[0] for h in ask("sipho dlamini", 1)] == ["account:A000001"]
    assert [h[0] for h in ask("P-000001")] == ["account:A000001", "account:A000002"]
    assert ask("D-1a2b3c4d") == [("device:D-1a2b3c4d", 1.0, "linked to 1 other node(s)")]
    assert ask("D-ffffffff") == [] and ask("S-083") == [] and ask("A000009") == []
    assert [h[0] for h in ask("082 123 4567")] == ["phone:+27821234567", "account:A000001", "account:A000002"]
    assert ask("0821234500")[0][2] == "registered on 0 account(s)"
    for bad in ("x", "y" * 101):
        with pytest.raises(ValueError):
            ask(bad)


def test_screen_dates_and_aliases(spark):
    day, other = dt.date(1988, 3, 14), dt.date(1990, 1, 1)
    openings = spark.createDataFrame([("KYC-1", "sipho dlamini", day), ("KYC-2", "sipho dlamini", other)],
                                     "record_id string, name_norm string, date_of_birth date")
    listed = list_entries(spark.createDataFrame([
        ("S-001", "Sipho M Dlamini", day, "L", []), ("S-002", "Sipho Dlamini", None, "L", []),
        ("S-003", "Sipho M Dlamini", None, "L", []), ("S-004", "Nobody Else", day, "L", ["Mr Sipho Dlamini"])],
        "entry_id string, full_name string, date_of_birth date, list_name string, aliases array<string>"))
    got = sorted((r.record_id, r.entry_id, r.score) for r in screen(openings, listed).collect())
    near = 0.875   # 14 of 16 trigrams
    want = [("KYC-1", "S-001", near), ("KYC-1", "S-002", 1.0), ("KYC-1", "S-004", 1.0), ("KYC-2", "S-002", 1.0)]
    if near >= 0.8:
        want += [("KYC-1", "S-003", near), ("KYC-2", "S-003", near)]
    assert got == sorted(want)


def score(left, right):
    a, b = ({f"  {w} "[i:i + 3] for w in name.split() for i in range(len(w) + 1)} for name in (left, right))
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("k, floor", [(1, 0.3), (3, 0.3), (10, 0.5), (4, 0.05)])
def test_top_k_names_equal_all_pairs(spark, k, floor):
    rng = random.Random(k)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(25)]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(160)} | {"", "aaaaaa", "aaaaab"})
    asked = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(30)} | {"", "zzz", "aaaaaa"})
    order = similarity.rarity(held := similarity.with_codes(spark.createDataFrame([(n,) for n in names], "name string"), "name"))
    queries = similarity.with_codes(spark.createDataFrame([(n,) for n in asked], "query string"), "query")
    queries, held = similarity.with_sets(queries, order), similarity.with_sets(held, order)
    seen = []
    got = {}
    for r in similarity.top_k_similar(queries, held, k, floor, "query", "name", seen).collect():
        got.setdefault(r.query, {})[r.name] = r.score
    for query in asked:
        scores = {n: score(query, n) for n in names}
        best = sorted((s for s in scores.values() if s >= floor), reverse=True)
        least = best[k - 1] if len(best) >= k else floor
        # Nothing among the best k is missing, ties included, and nothing is below the floor.
        assert {n for n, s in scores.items() if s >= least and s > 0} <= set(got.get(query, {}))
        assert all(abs(scores[n] - s) < 1e-12 and s >= floor for n, s in got.get(query, {}).items())
    everything = _all_candidates(queries, held)
    assert sum(df.count() for df in seen) <= 2 * everything


def _all_candidates(asked, held):
    low = F.lit(0.05)
    return similarity._candidates(similarity._placed(asked, low, ["query"], "l_"),
                                  similarity._placed(held, low, ["name"], "r_"), low, low).count()


def test_a_crowd_of_close_names_prunes_the_rest(spark):
    """Where many names are close to a query, the second look leaves out almost all that share a trigram only."""
    rng = random.Random(6)
    names = {f"anna maria van der berg {a}{b}" for a in "abcdefgh" for b in "abcdefgh"}
    names |= {" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3)) + " berg" for _ in range(900)}
    held = similarity.with_codes(spark.createDataFrame([(n,) for n in sorted(names)], "name string"), "name")
    asked = similarity.with_codes(spark.createDataFrame([("anna maria van der berg",)], "query string"), "query")
    order, seen = similarity.rarity(held), []
    asked, held = similarity.with_sets(asked, order), similarity.with_sets(held, order)
    assert similarity.top_k_similar(asked, held, 10, 0.3, "query", "name", seen).count() >= 10
    plain = similarity._candidates(
        similarity._placed(asked, F.lit(0.3), ["query"], "l_"), similarity._placed(held, F.lit(0.3), ["name"], "r_"),
        F.lit(0.3), F.lit(0.3)).count()
    assert 2 * sum(df.count() for df in seen) <= plain


def test_screened_openings_are_folded_before_entries_multiply_them(spark):
    """Links equal those of every (opening, entry) event, and rows of persons with one spelling are not dealt by entry."""
    rng = random.Random(8)
    born, names = [dt.date(1980, 1, 1), dt.date(1980, 1, 2), None], ["anna berg", "anna bergh", "carl diaz", "emil fox", None]
    rows = [(rng.choice([f"KYC-{n:03d}", f"KYC-{n:03d}", None]), f"P-{n:02d}" if n < 40 else rng.choice(["P-91", "P-92", None]),
             rng.choice(names), rng.choice(born), T0 + dt.timedelta(hours=rng.randint(0, 99)), rng.choice([n, 7])) for n in range(160)]
    opened = spark.createDataFrame(rows, "record_id string, person_id string, name_norm string, date_of_birth date, opened_at timestamp, "
                                         "arrival bigint")
    listed = spark.createDataFrame([(f"S-{i}" if i else None, rng.choice(names[:4]), ["anna bergh"] if i % 3 else [], rng.choice(born))
                                    for i in range(30)],
                                   "entry_id string, name_norm string, aliases_norm array<string>, date_of_birth date")
    want = links.fold_events(links.sanction_events(screen(opened, listed)), 3)
    folds = screen_folds(opened, listed, 3)
    assert dict(folds.dtypes) == dict(want.dtypes)
    assert sorted(map(str, folds.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert want.filter("weight > 1").count() > 20 and want.filter("weight = 1").count() > 20
    alone = screen_folds(opened.filter("person_id < 'P-40'"), listed, 3).filter("src < 'person:P-40'")
    assert alone.count() == want.filter("src < 'person:P-40'").count() > 20
    dealt = [line for line in str(alone._jdf.queryExecution().optimizedPlan()).split("\n") if "Aggregate" in line and "dst" in line]
    assert len(dealt) == 1    # the second fold, for persons of several spellings only
