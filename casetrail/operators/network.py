"""Breadth-first walk over the link graph, for many centers at once.

Per hop: the distinct frontier nodes pick their links (a semi-join, so a link table of any size is
only scanned), every node keeps its strongest 25, and those few rows are joined to the frontier.
The ranking does not depend on the center, so a node met from many centers is ranked once, and
the rank limit prunes a hub before the shuffle. Per center the walk holds at most `max_nodes` nodes.

The order of discovery is that of a first-in-first-out queue: parents by their own number, their
links by strength. It decides which nodes fit under the cap.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions.ids import NODE_ID, node, node_ident, node_kind
from casetrail.operators.links import of_kinds, strongest_first
from casetrail.session import cut

PER_NODE = 25
MAX_NODES = 150
MAX_DEPTH = 3
EVIDENCE_SHOWN = 5


def mirrored(links: DataFrame) -> DataFrame:
    """Every link seen from both ends: (node, other, link columns). A loop appears once."""
    ends = F.array_distinct(F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return links.select(F.explode(ends).alias("ends"), *links.columns).select("ends.*", *links.columns)


def strongest_links(links: DataFrame, nodes: DataFrame | None, per_node: int = PER_NODE) -> DataFrame:
    """At most per_node + 1 links per node with their rank; the extra one tells that more exist."""
    seen = mirrored(links)
    if nodes is not None:
        seen = seen.join(nodes, "node", "left_semi")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(*strongest_first()))
    return seen.withColumn("rank", rank).filter(F.col("rank") <= per_node + 1)


def degree(links: DataFrame) -> DataFrame:
    """Links that point at a node (what a device or sanctions search reports)."""
    return links.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("linked_from"))


def labels(nodes: DataFrame, accounts: DataFrame, persons: DataFrame, column: str = "node_id") -> DataFrame:
    """Adds kind and label: account holder, person's display name, or the bare id."""
    names = accounts.select(node("account", F.col("account_id")).alias(column), F.col("full_name").alias("_name"))
    names = names.unionByName(persons.select(node("person", F.col("person_id")).alias(column),
                                             F.col("display_name").alias("_name")))
    return (nodes.join(names, column, "left")
            .withColumn("kind", node_kind(F.col(column)))
            .withColumn("label", F.coalesce("_name", node_ident(F.col(column)))).drop("_name"))


def walk(links: DataFrame, centers: DataFrame, depth: int = 1, kinds: list[str] | None = None,
         per_node: int = PER_NODE, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, truncated) as flat tables keyed by center.

    nodes: center, node_id, ordinal, distance; edges: center and the link; truncated: one row per
    center that hit a limit.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    chosen = of_kinds(links, kinds)
    visited = cut(centers.select("center").distinct().select(
        "center", F.col("center").alias("node"), F.lit(1).alias("ordinal"), F.lit(0).alias("distance")))
    edges = cutoffs = None
    for hop in range(1, depth + 1):
        frontier = visited.filter(F.col("distance") == hop - 1)
        near = strongest_links(chosen, frontier.select("node").distinct(), per_node)
        steps = cut(frontier.select("center", "node", F.col("ordinal").alias("parent")).join(near, "node"))
        more_links = steps.filter(F.col("rank") > per_node).select("center")
        steps = steps.filter(F.col("rank") <= per_node)
        new_edges = steps.select("center", *links.columns)

        met = (steps.groupBy("center", F.col("other").alias("node"))
               .agg(F.min(F.struct("parent", "rank")).alias("found")))
        met = met.join(visited.select("center", "node"), ["center", "node"], "left_anti")
        sizes = visited.groupBy("center").agg(F.count("*").cast("int").alias("so_far"))
        place = F.row_number().over(Window.partitionBy("center").orderBy("found"))
        met = cut(met.join(sizes, "center").withColumn("ordinal", F.col("so_far") + place))
        too_many = met.filter(F.col("ordinal") > max_nodes).select("center")
        new_nodes = met.filter(F.col("ordinal") <= max_nodes).select(
            "center", "node", "ordinal", F.lit(hop).alias("distance"))

        visited = visited.unionByName(new_nodes)
        edges = new_edges if edges is None else edges.unionByName(new_edges)
        flags = more_links.unionByName(too_many)
        cutoffs = flags if cutoffs is None else cutoffs.unionByName(flags)

    # A link found from both ends is one edge; one whose far end did not fit is none.
    edges = edges.dropDuplicates(["center", "src", "dst", "kind"])
    for end in ("src", "dst"):
        edges = edges.join(visited.select("center", F.col("node").alias(end)), ["center", end], "left_semi")
    edges = edges.withColumn("evidence_ids", F.slice("evidence_ids", 1, EVIDENCE_SHOWN))
    nodes = visited.withColumnRenamed("node", "node_id")
    return nodes, edges.select("center", *links.columns), cutoffs.distinct()


def network(links: DataFrame, centers: DataFrame, accounts: DataFrame, persons: DataFrame,
            depth: int = 1, kinds: list[str] | None = None, per_node: int = PER_NODE,
            max_nodes: int = MAX_NODES) -> DataFrame:
    """One row per center that has links: depth, nodes, edges (arrays), truncated."""
    nodes, edges, cutoffs = walk(links, centers, depth, kinds, per_node, max_nodes)
    nodes = (labels(nodes, accounts, persons).groupBy("center")
             .agg(F.array_sort(F.collect_list(F.struct("node_id", "kind", "label"))).alias("nodes")))
    edge = F.struct("src", "dst", "kind", "weight", F.col("total_zar").cast("double").alias("total_zar"),
                    "score", "first_seen", "last_seen", "evidence_ids")
    edges = edges.groupBy("center").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return (nodes.join(edges, "center", "left")
            .join(cutoffs.withColumn("truncated", F.lit(True)), "center", "left")
            .filter((F.size("nodes") > 1) | F.col("edges").isNotNull())
            .select("center", F.lit(depth).alias("depth"), "nodes",
                    F.coalesce("edges", F.array().cast(edges.schema["edges"].dataType)).alias("edges"),
                    F.coalesce("truncated", F.lit(False)).alias("truncated")))


def network_of(links: DataFrame, center: str, accounts: DataFrame, persons: DataFrame, **limits) -> DataFrame:
    """The single-center question; no row means the node has no links."""
    if not re.match(NODE_ID, center):
        raise ValueError("not a node id: write kind:id, as in device:D-00ff00ff")
    one = links.sparkSession.createDataFrame([(center,)], "center string")
    return network(links, one, accounts, persons, **limits)
