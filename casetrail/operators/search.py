"""Entity search: a text names an account, person, device, sanctions entry, phone or a name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions.ids import node, query_kind
from casetrail.functions.text import normalise_name, normalise_phone
from casetrail.operators.network import degree
from casetrail.operators.similarity import rarity, top_k_similar, with_codes, with_sets
from casetrail.session import cut

ACCOUNT_MATCH, SANCTION_MATCH = 0.3, 0.5
SANCTION_HITS = 3
EXACT_HITS = 25
HIT = ["query", "node_id", "kind", "label", "detail", "score", "evidence_ids"]


# The wording of the details.
def account_detail() -> Column:
    return F.format_string(
        "owner person:%s | phone %s | %s | opened %s | resolved by %s", "person_id", "phone_e164",
        F.coalesce("city", F.lit("None")), F.date_format("opened_at", "yyyy-MM-dd"), "matched_rule")


def sanction_detail() -> Column:
    return F.format_string("%s entry, date of birth %s", "list_name",
                           F.coalesce(F.date_format("date_of_birth", "yyyy-MM-dd"), F.lit("not listed")))


def _account_hits(df: DataFrame, score: Column, *more: str) -> DataFrame:
    return df.select("query", node("account", F.col("account_id")).alias("node_id"), F.lit("account").alias("kind"),
                     F.col("full_name").alias("label"), account_detail().alias("detail"), score.alias("score"),
                     F.array("kyc_evidence_id").alias("evidence_ids"), F.lit(1).alias("_kind_rank"),
                     F.col("account_id").alias("_tie"), *more)


def _best(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return df.withColumn("_n", rank).filter(F.col("_n") <= k).drop("_n")


def _first_bearers(accounts: DataFrame, key: str, wanted: DataFrame, k: int) -> DataFrame:
    """The k smallest account ids of every wanted key. Accounts with equal keys score alike, so no
    other account can be among the best k; a key many accounts share stays short in the join."""
    some = accounts.join(wanted.distinct(), key, "left_semi")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("account_id"))
    return some.withColumn("_n", rank).filter(F.col("_n") <= k).drop("_n")


def search_by_id(queries: DataFrame, accounts: DataFrame, links: DataFrame) -> DataFrame:
    """Account and person ids give accounts (at most 25); device and sanctions ids give their node
    when something links to it."""
    asked = queries.withColumn("_asked", query_kind(F.col("query")))
    exact = F.lit(1.0)
    found = []
    for kind, column in (("account", "account_id"), ("person", "person_id")):
        some = asked.filter(F.col("_asked") == kind).select("query")
        bearers = _first_bearers(accounts, column, some.select(F.col("query").alias(column)), EXACT_HITS)
        hits = some.join(bearers, F.col("query") == F.col(column))
        found.append(_best(_account_hits(hits, exact), [F.col("_tie")], EXACT_HITS))
    other = asked.filter(F.col("_asked").isin("device", "sanction")).select(
        "query", F.col("_asked").alias("kind"), F.concat_ws(":", "_asked", "query").alias("node_id"))
    pointing = links.join(other.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi")
    nodes = other.join(degree(pointing), "node_id").select(
        "query", "node_id", "kind", F.col("query").alias("label"),
        F.format_string("linked to %d other node(s)", "linked_from").alias("detail"), exact.alias("score"),
        F.array().cast("array<string>").alias("evidence_ids"), F.lit(0).alias("_kind_rank"), F.lit("").alias("_tie"))
    return found[0].unionByName(found[1]).unionByName(nodes)


def search_by_phone(queries: DataFrame, accounts: DataFrame) -> DataFrame:
    """The phone's node, even with no account, and the accounts registered on it (at most 25)."""
    asked = (queries.filter(query_kind(F.col("query")) == "phone")
             .withColumn("_phone", normalise_phone(F.col("query"))))
    bearers = _first_bearers(accounts, "phone_e164", asked.select(F.col("_phone").alias("phone_e164")), EXACT_HITS)
    hits = asked.join(bearers, F.col("_phone") == F.col("phone_e164"))
    hits = _best(_account_hits(hits, F.lit(1.0)), [F.col("_tie")], EXACT_HITS)
    count = hits.groupBy("query").agg(F.count("*").alias("n"))
    nodes = asked.join(count, "query", "left").select(
        "query", node("phone", F.col("_phone")).alias("node_id"), F.lit("phone").alias("kind"),
        F.col("_phone").alias("label"),
        F.format_string("registered on %d account(s)", F.coalesce("n", F.lit(0))).alias("detail"),
        F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("evidence_ids"),
        F.lit(0).alias("_kind_rank"), F.lit("").alias("_tie"))
    return nodes.unionByName(hits)


def search_by_name(queries: DataFrame, accounts: DataFrame, sanctions: DataFrame, limit: int = 10) -> DataFrame:
    """Accounts at least 0.3 similar (best `limit`) and the 3 best list entries of at least 0.5,
    compared by the entry's own name only."""
    asked = (queries.filter(query_kind(F.col("query")) == "name")
             .withColumn("_name", normalise_name(F.col("query"))))
    # Names are matched once each; the accounts and entries that bear them are looked up afterwards.
    held = with_codes(accounts.select("name_norm").distinct(), "name_norm")
    listed = with_codes(sanctions.select("name_norm").distinct(), "name_norm")
    order = rarity(held, listed)
    asked = with_sets(with_codes(asked, "_name"), order)
    held, listed = with_sets(held, order), with_sets(listed, order)

    def matched(names: DataFrame, floor: float, k: int) -> DataFrame:
        return top_k_similar(asked, names, k, floor, "query", "name_norm").withColumnRenamed("score", "_score")

    near = matched(held, ACCOUNT_MATCH, limit)
    hits = near.join(_first_bearers(accounts, "name_norm", near.select("name_norm"), limit), "name_norm")
    hits = _best(hits, [F.col("_score").desc(), F.col("account_id")], limit)
    entries = matched(listed, SANCTION_MATCH, SANCTION_HITS).join(sanctions, "name_norm")
    entries = _best(entries, [F.col("_score").desc(), F.col("entry_id")], SANCTION_HITS)
    score = F.round("_score", 3)
    entries = entries.select(
        "query", node("sanction", F.col("entry_id")).alias("node_id"), F.lit("sanction").alias("kind"),
        F.col("full_name").alias("label"), sanction_detail().alias("detail"), score.alias("score"),
        F.array("entry_id").alias("evidence_ids"), F.lit(2).alias("_kind_rank"), F.col("entry_id").alias("_tie"),
        F.col("_score"))
    both = _account_hits(hits, score, "_score").unionByName(entries)
    order = [F.col("score").desc(), F.col("_kind_rank"), F.col("_score").desc(), F.col("_tie")]
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    both = both.withColumn("_n", place).filter(F.col("_n") <= limit)
    return both.withColumn("_tie", F.lpad(F.col("_n").cast("string"), 4, "0")).drop("_n", "_score")


def search_entities(queries: DataFrame, accounts: DataFrame, sanctions: DataFrame, links: DataFrame,
                    limit: int = 10) -> DataFrame:
    """Hits of every query text, best first within a query (column `position`)."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    asked = cut(queries.select(F.trim("query").alias("query")).distinct())
    # At most one row for each kind of id; only the kinds that are asked for are planned.
    kinds = {r["kind"] for r in asked.select(query_kind(F.col("query")).alias("kind")).distinct().collect()}
    found = []
    if kinds - {"phone", "name"} or not kinds:
        found.append(search_by_id(asked, accounts, links))
    if "phone" in kinds:
        found.append(search_by_phone(asked, accounts))
    if "name" in kinds:
        found.append(search_by_name(asked, accounts, sanctions, limit))
    hits = reduce(DataFrame.unionByName, found)
    order = [F.col("score").desc(), F.col("_kind_rank"), F.col("_tie")]
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return hits.withColumn("position", place).select(*HIT, "position")


def search(text: str, accounts: DataFrame, sanctions: DataFrame, links: DataFrame, limit: int = 10) -> DataFrame:
    """The single question."""
    if not 2 <= len(text) <= 100:
        raise ValueError("a search text has 2 to 100 characters")
    one = accounts.sparkSession.createDataFrame([(text,)], "query string")
    return search_entities(one, accounts, sanctions, links, limit).orderBy("position")
