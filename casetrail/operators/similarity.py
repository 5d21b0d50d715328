"""Set-similarity join over trigram sets.

Exact prefix-filtered join (Bayardo, Ma, Srikant, WWW 2007; Xiao et al., WWW 2008): put the
trigrams of every name in one global order, rarest first. Two names that reach the bound share a
trigram within a short prefix of both, so it is enough to equi-join on (block, prefix trigram) and
verify. A pair is emitted only for the smallest trigram the two names share, which is always in
both prefixes, so no distinct is needed afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions.trigrams import UNIVERSE, Threshold, similarity, trigram_codes
from casetrail.session import cut


def rarity(*sets: DataFrame) -> Column:
    """A lookup array: position of every trigram code when sorted rarest first, as one foldable literal."""
    return as_order(rarity_positions(*sets))


def as_order(position: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, position))), ",").cast("array<int>")


def rarity_positions(*sets: DataFrame) -> list[int]:
    """Position of every trigram code when sorted rarest first.

    Reads at most UNIVERSE (19,683) counts to the driver, whatever the number of names. Any order
    gives a right join; this one gives short candidate lists.
    """
    codes = reduce(DataFrame.unionAll, [s.select(F.explode("codes").alias("code")) for s in sets])
    counts = {r["code"]: r["n"] for r in codes.groupBy("code").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(UNIVERSE), key=lambda code: (counts.get(code, 0), code))
    position = [0] * UNIVERSE
    for at, code in enumerate(order):
        position[code] = at
    return position


def with_codes(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("codes", trigram_codes(F.col(name)))


def _prefixes(df: DataFrame, order: Column | None, bound: Threshold, columns: list[str],
              block: list[str], side: str) -> DataFrame:
    if "set" in df.columns:
        ranked = df.filter(F.size("set") > 0).select(*columns, *block, "set")
    else:
        ranked = df.filter(F.size("codes") > 0).select(
            *columns, *block,
            F.array_sort(F.transform("codes", lambda c: F.get(order, c))).alias("set"))
    prefix = F.slice("set", F.lit(1), bound.prefix_length(F.size("set")))
    out = ranked.select(
        *[F.col(c).alias(f"{side}{c}") for c in columns],
        *[F.col(c).alias(f"{side}b{n}") for n, c in enumerate(block)],
        F.col("set").alias(f"{side}set"), F.explode(prefix).alias(f"{side}token"))
    return out


def similarity_join(left: DataFrame, right: DataFrame, bound: Threshold, left_columns: list[str],
                    right_columns: list[str], block: list[str] = (), order: Column | None = None,
                    condition=None) -> DataFrame:
    """Pairs whose names reach the bound, within equal `block` values.

    Both inputs carry `codes`, or both `set` (`with_sets`, one order). The answer has the named columns (prefixed l_ and r_) and
    `common`, `total` (sizes of intersection and union) and `score`. `condition` may add a test on
    the l_ and r_ columns, applied inside the join.
    """
    block = list(block)
    if order is None and "set" not in left.columns:
        order = rarity(left, right)
    a = _prefixes(left, order, bound, left_columns, block, "l_")
    b = _prefixes(right, order, bound, right_columns, block, "r_")
    on = F.lit(True) if condition is None else condition
    for n in range(len(block)):
        on = on & (F.col(f"l_b{n}") == F.col(f"r_b{n}"))
    return _verified(a, b, bound, left_columns, right_columns, on)


def _verified(a: DataFrame, b: DataFrame, bound: Threshold, left_columns: list[str], right_columns: list[str],
              condition: Column) -> DataFrame:
    """Pairs of prefix rows that share a token and reach the bound, once for each pair."""
    size_a, size_b = F.size("l_set"), F.size("r_set")
    on = (F.col("l_token") == F.col("r_token")) & bound.sizes_fit(size_a, size_b) & condition
    # One-element array so that the intersection is worked out once for both tests.
    verified = F.exists(
        F.array(F.array_intersect("l_set", "r_set")),
        lambda shared: (F.get(shared, 0) == F.col("l_token"))
        & bound.reached(F.size(shared), size_a, size_b))
    common = F.size(F.array_intersect("l_set", "r_set"))
    return a.join(b, on & verified).select(
        *[f"l_{c}" for c in left_columns], *[f"r_{c}" for c in right_columns],
        common.alias("common"), (size_a + size_b - common).alias("total"),
        similarity(F.col("l_set"), F.col("r_set")).alias("score"))


def postings(df: DataFrame, order: Column, bound: Threshold, columns: list[str]) -> DataFrame:
    """The inverted index of names: `token` (place in the order), `set` and the named columns, for every prefix trigram.

    `df` carries `codes`. Stored postings can be probed with the same order and any bound not below this one.
    """
    return _prefixes(df, order, bound, columns, [], "")


def probe(stored: DataFrame, stored_columns: list[str], asked: DataFrame, asked_columns: list[str], order: Column,
          bound: Threshold, condition: Column | None = None) -> DataFrame:
    """`similarity_join` with stored postings as its left side."""
    a = stored.select(*[F.col(c).alias(f"l_{c}") for c in [*stored_columns, "set", "token"]])
    b = _prefixes(asked, order, bound, asked_columns, [], "r_")
    return _verified(a, b, bound, stored_columns, asked_columns, F.lit(True) if condition is None else condition)


SOON = 0.8        # first look of `top_k_similar`: trigrams two names at least so similar must share
EDGE = 1e-9       # bounds are rounded down by this much, scores are compared as they are


def with_sets(df: DataFrame, order: Column) -> DataFrame:
    """df with `set`, the places of its `codes` in the order; written down, so that the long order is in one small plan only."""
    return cut(df.withColumn("set", F.array_sort(F.transform("codes", lambda c: F.get(order, c)))).drop("codes"))


def _placed(df: DataFrame, floor: Column, columns: list[str], side: str) -> DataFrame:
    """One row for each trigram a name of similarity `floor` could be found by, with its place in the ordered set."""
    prefix = F.slice("set", F.lit(1), _reach(F.size("set"), floor))
    return df.filter(F.size("set") > 0).select(*[F.col(c).alias(f"{side}{c}") for c in columns], F.col("set").alias(f"{side}set"),
                         F.size("set").alias(f"{side}size"), F.posexplode(prefix).alias(f"{side}at", f"{side}token"))


def _reach(size: Column, bound: Column) -> Column:
    return (size - F.ceil(size * bound - EDGE) + 1).cast("int")


def _candidates(asked: DataFrame, held: DataFrame, near: Column, bound: Column) -> DataFrame:
    """Rows that share a trigram among the first of both (for a similarity of `near`) and can still reach `bound`
    by their sizes and by what is left of both sets after the shared place."""
    a, b = F.col("l_size"), F.col("r_size")
    left = F.least(a - F.col("l_at"), b - F.col("r_at"))
    on = ((F.col("l_token") == F.col("r_token")) & (F.col("l_at") < _reach(a, near)) & (F.col("r_at") < _reach(b, near))
          & (b >= a * bound - EDGE) & (a >= b * bound - EDGE) & (left * (1 + bound) >= (a + b) * bound - EDGE))
    return asked.join(held, on)


def _scored(candidates: DataFrame, asked: str, held: str) -> DataFrame:
    """Pairs with score, each once: at the smallest trigram both share, which lies in both prefixes."""
    shared = F.array_intersect("l_set", "r_set")
    pairs = candidates.select(f"l_{asked}", f"r_{held}", "l_token", shared.alias("shared"),
                              (F.col("l_size") + F.col("r_size")).alias("both"), *[c for c in ("l_least",) if c in candidates.columns])
    pairs = pairs.filter(F.get("shared", F.lit(0)) == F.col("l_token"))
    return pairs.withColumn("score", F.size("shared") / (F.col("both") - F.size("shared")))


def top_k_similar(asked: DataFrame, held: DataFrame, k: int, floor: float, query: str, name: str,
                  seen: list[DataFrame] | None = None) -> DataFrame:
    """query, name, score: of every query all names that are at least `floor` similar and not beaten by k others.

    A first look by few rare trigrams gives every query k names; the k-th of them is its bound from then
    on, which shortens the prefixes of the second, exact look and prunes by sizes and places (Xiao et al., ICDE 2009).
    Both inputs carry `set` (`with_sets`, one order); names are distinct. `seen` collects the candidate tables, for measuring.
    """
    low = F.lit(floor)
    names = _placed(held, low, [name], "r_")
    first = _candidates(_placed(asked, F.lit(max(floor, SOON)), [query], "l_"), names, F.lit(max(floor, SOON)), low)
    rank = F.row_number().over(Window.partitionBy(f"l_{query}").orderBy(F.desc("score")))
    kth = (_scored(first, query, name).filter(F.col("score") >= low).withColumn("rank", rank).filter(F.col("rank") <= k)
           .filter(F.col("rank") == k).select(F.col(f"l_{query}").alias(query), F.col("score").alias("least")))
    bounded = cut(asked.join(kth, query, "left").withColumn("least", F.greatest(F.coalesce("least", low), low)))
    second = _candidates(_placed(bounded, F.col("least"), [query, "least"], "l_"), names, F.col("l_least"), F.col("l_least"))
    if seen is not None:
        seen += [first, second]
    return _scored(second, query, name).filter(F.col("score") >= F.col("l_least")).select(
        F.col(f"l_{query}").alias(query), F.col(f"r_{name}").alias(name), "score")
