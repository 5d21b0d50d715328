"""Network traversal over the links of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions.ids import node
from casetrail.operators.network import degree, labels, network, strongest_links, walk
from casetrail.plans.money import all_links
from casetrail.plans.registry import question
from casetrail.session import cut
from casetrail.sources import tables

PER_NODE = 12


def near_sql(per_node: int, kinds: str = "TRUE") -> str:
    return f""",
mirrored AS (SELECT src AS node, dst AS other, * FROM links WHERE {kinds}
             UNION ALL SELECT dst, src, * FROM links WHERE {kinds}),
near AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY
    kind IN ('OWNS', 'REGISTERED_PHONE', 'SANCTIONS_MATCH') DESC, weight DESC, total_zar DESC NULLS LAST,
    kind, src, dst) AS rank FROM mirrored) WHERE rank <= {per_node + 1})"""


def hop_sql(hop: int, per_node: int, max_nodes: int) -> str:
    """One hop of the walk, from visited<hop-1> to visited<hop>."""
    was, now = f"visited{hop - 1}", f"visited{hop}"
    return f""",
steps{hop} AS (SELECT v.center, v.node AS at, v.ordinal AS parent, near.* FROM {was} v JOIN near USING (node)
               WHERE v.distance = {hop - 1}),
met{hop} AS (
  SELECT center, other AS node, min((parent, rank)) AS found FROM steps{hop} WHERE rank <= {per_node}
  AND NOT EXISTS (SELECT 1 FROM {was} v WHERE v.center = steps{hop}.center AND v.node = steps{hop}.other)
  GROUP BY center, other),
placed{hop} AS (
  SELECT m.center, m.node, (SELECT count(*) FROM {was} v WHERE v.center = m.center)
         + row_number() OVER (PARTITION BY m.center ORDER BY found) AS ordinal FROM met{hop} m),
{now} AS (SELECT * FROM {was} UNION ALL
          SELECT center, node, ordinal, {hop} FROM placed{hop} WHERE ordinal <= {max_nodes})"""


def walk_sql(centers: str, depth: int, per_node: int, max_nodes: int, kinds: str = "TRUE") -> str:
    hops = range(1, depth + 1)
    steps = " UNION ALL ".join(f"SELECT center, src, dst, kind, weight, rank FROM steps{h}" for h in hops)
    capped = " UNION ".join(f"SELECT center FROM placed{h} WHERE ordinal > {max_nodes}" for h in hops)
    return near_sql(per_node, kinds) + f""",
visited0 AS (SELECT center, center AS node, 1::BIGINT AS ordinal, 0 AS distance FROM ({centers}))""" + "".join(
        hop_sql(h, per_node, max_nodes) for h in hops) + f""",
visited AS (SELECT * FROM visited{depth}),
steps AS ({steps}),
cut AS (SELECT center FROM steps WHERE rank > {per_node} UNION {capped}),
edges AS (SELECT DISTINCT center, src, dst, kind, weight FROM steps WHERE rank <= {per_node}
          AND (center, src) IN (SELECT (center, node) FROM visited)
          AND (center, dst) IN (SELECT (center, node) FROM visited))"""


NETWORK_SQL = """
SELECT v.center, string_agg(v.node, ',' ORDER BY v.node) AS nodes,
       any_value((SELECT string_agg(src || ' ' || kind || ' ' || dst || ' ' || CAST(weight AS VARCHAR), ','
                  ORDER BY src, dst, kind) FROM edges e WHERE e.center = v.center)) AS edges,
       any_value(v.center IN (SELECT center FROM cut)) AS truncated
FROM visited v GROUP BY v.center HAVING count(*) > 1"""


def network_rows(answers):
    edge = F.transform("edges", lambda e: F.concat_ws(" ", e["src"], e["kind"], e["dst"], e["weight"].cast("string")))
    return answers.select("center", F.array_join(F.transform("nodes", lambda n: n["node_id"]), ",").alias("nodes"),
                          F.array_join(edge, ",").alias("edges"), "truncated")


def people(spark, folder):
    accounts = tables.accounts(spark, folder)
    return accounts, accounts.select("person_id", F.col("full_name").alias("display_name"))


def device_centers(spark, folder):
    return tables.logins(spark, folder).select(node("device", F.col("device_id")).alias("center")).distinct()


DEVICES = "SELECT DISTINCT 'device:' || device_id AS center FROM logins"
ACCOUNTS = "SELECT 'account:' || account_id AS center FROM accounts"


@question("SELECT dst AS node_id, count(*) AS linked_from FROM links GROUP BY dst")
def node_degree(spark, folder):
    return degree(all_links(spark, folder))


@question(near_sql(PER_NODE) + f"""
SELECT node, other, kind, rank FROM near WHERE rank <= {PER_NODE}""")
def node_strongest_links(spark, folder):
    near = strongest_links(all_links(spark, folder), None, PER_NODE).filter(F.col("rank") <= PER_NODE)
    return near.select("node", "other", "kind", F.col("rank").cast("bigint").alias("rank"))


@question(walk_sql(ACCOUNTS, 1, PER_NODE, 150) + NETWORK_SQL)
def network_depth1(spark, folder):
    """Direct links of every account."""
    accounts, persons = people(spark, folder)
    centers = accounts.select(node("account", F.col("account_id")).alias("center"))
    return network_rows(network(cut(all_links(spark, folder)), centers, accounts, persons, 1, per_node=PER_NODE))


@question(walk_sql(DEVICES, 2, 25, 150) + NETWORK_SQL)
def network_depth2(spark, folder):
    """Links of links of every device, with the usual limits."""
    accounts, persons = people(spark, folder)
    return network_rows(network(cut(all_links(spark, folder)), device_centers(spark, folder), accounts, persons, 2))


@question(walk_sql(DEVICES, 3, PER_NODE, 60) + NETWORK_SQL)
def network_depth3_capped(spark, folder):
    """Three hops from every device under limits that cut in."""
    accounts, persons = people(spark, folder)
    return network_rows(network(cut(all_links(spark, folder)), device_centers(spark, folder), accounts, persons, 3,
                                per_node=PER_NODE, max_nodes=60))


@question(walk_sql(ACCOUNTS, 2, 25, 150, "kind IN ('LOGGED_IN_FROM')") + NETWORK_SQL)
def network_shared_devices(spark, folder):
    """Accounts that share a device with each account."""
    accounts, persons = people(spark, folder)
    centers = accounts.select(node("account", F.col("account_id")).alias("center"))
    return network_rows(network(cut(all_links(spark, folder)), centers, accounts, persons, 2, ["LOGGED_IN_FROM"]))


@question(walk_sql(DEVICES, 1, 25, 150) + """
SELECT v.center, v.node AS node_id, split_part(v.node, ':', 1) AS kind,
       coalesce(a.full_name, substr(v.node, strpos(v.node, ':') + 1)) AS label, v.ordinal, v.distance
FROM visited v LEFT JOIN accounts a ON v.node = 'account:' || a.account_id""")
def network_labels(spark, folder):
    accounts, persons = people(spark, folder)
    nodes, _, _ = walk(cut(all_links(spark, folder)), device_centers(spark, folder), 1)
    return labels(nodes, accounts, persons).select(
        "center", "node_id", "kind", "label", F.col("ordinal").cast("bigint").alias("ordinal"), "distance")
