"""Personal data: fixed forms, and identifiers discovered from the words before known ones.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by their forms. They are the
seeds of a bootstrap: the two words before a seed are a lexical pattern. Candidates are what may follow a
pattern: runs of up to eight tokens with digits or of short capitals with at least one digit (numbers and
identifiers in groups), and addresses written around at and dot. How many digits there are decides nothing. Patterns and values form a graph. In each
round a pattern scores, for a kind, the mean confidence of its distinct values (with enough support), and a
value not known yet gets the mean score of its patterns. Candidates of values at or above ACCEPT
after ROUNDS rounds become spans of their kind, beside the base spans, which always stay.

Only built-in functions. The text is read once; after that only spans, contexts and scores move. Copies
of a document add nothing to a pattern: edges count once for each distinct value.

Positions are code points, end exclusive. Null texts are empty. Rows are independent: repeated rows give
repeated results, and doc_id is only passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import written

KINDS = ("email", "ip", "card", "phone")
# The forms. Possessive repeats and the look-behinds change no match; they keep long runs linear.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
# A token with a digit, of at most 64 characters, and the groups after it; short capitals may stand before.
GROUP = r"[^\s0-9]{0,63}+[0-9]\S{0,63}+(?!\S)"
CANDIDATE = (r"(?<!\S)(?:[A-Z]{1,4}\x20)?" + GROUP + r"(?:(?<![.,;:!?])\x20(?:" + GROUP + r"|[A-Z]{1,4}(?=\x20?" + GROUP + r")\x20?" + GROUP + r")){0,7}+")
AT, DOT = r"(?:\x20?[(\[{]\x20?(?i:at|@)\x20?[)\]}]\x20?)", r"(?:\x20?[(\[{]\x20?(?i:dot|\.)\x20?[)\]}]\x20?|\x20(?i:dot)\x20|\.)"
NAME = r"[A-Za-z0-9_%+-]{1,64}+"
ADDRESS = (r"(?<![A-Za-z0-9._%+-])" + NAME + "(?:" + DOT + NAME + "){0,4}(?:" + AT + r"|\x20(?i:at)\x20|\x20@\x20)"
           + NAME + "(?:" + DOT + NAME + "){1,4}")
CONTEXT = 80
SUPPORT, ACCEPT, ROUNDS = 3.0, 0.7, 3

_SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, form: str, needs: str | None = None) -> Column:
    """Leftmost non-overlapping matches with their places, from the pieces between matches and the matches."""
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    between = F.slice(F.split(text, form, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("skip"), m.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, pair):
        begin = acc["at"] + pair["skip"]
        end = begin + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("out"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(text.contains(needs), spans).otherwise(F.array().cast(_SPAN)) if needs else spans


def luhn(digits: Column) -> Column:
    """Whether the check digit fits; every second digit from the right is doubled."""
    def value(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)
    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(small))
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = matches(text, FORMS[kind], NEEDS.get(kind))
    return F.filter(found, lambda s: valid(kind, s["value"])) if kind != "email" else found


def candidates(text: Column) -> Column:
    """What may be an identifier, without the punctuation around it; addresses first."""
    def bare(s):
        lead = F.length(F.regexp_extract(s["value"], r"^[\"'(\[<{]*", 0))
        value = F.regexp_replace(F.regexp_replace(s["value"], r"^[\"'(\[<{]*", ""), r"[.,;:!?)\]>}\"']*$", "")
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(value)).alias("end"),
                        value.alias("value"))
    none = F.array().cast(_SPAN)
    numbers = F.when(text.rlike("[0-9]"), F.transform(matches(text, CANDIDATE), bare)).otherwise(none)
    found = F.when(text.rlike(r"(?i)[(\[{\x20](?:at|@)[)\]}\x20]"), matches(text, ADDRESS)).otherwise(none)
    beside = F.filter(numbers, lambda c: ~F.exists(found, lambda a: (c["start"] < a["end"]) & (a["start"] < c["end"])))
    return F.concat(found, beside)


def context(text: Column, start: Column) -> Column:
    """The two words before a place, lower-cased, digits alike; null at the beginning of a text."""
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
    words = F.regexp_extract_all(F.translate(before, "123456789", "000000000"), F.lit(r"\S+"), F.lit(0))
    last = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(words) > 0, F.array_join(last, " "))


def value_key(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}@]", ""))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def span_texts(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans (order, start, end, kind) in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _labelled(spans: Column, order: int, kind: str | None) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"),
        F.lit(kind).cast("string").alias("kind"), s["value"].alias("value")))


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, row, base (all base spans), seen (base spans and candidates with their contexts)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    for kind in KINDS:
        df = df.withColumn(kind, base_spans(F.col("text"), kind))
    df = df.withColumn("more", candidates(F.col("text")))
    base = F.concat(*[_labelled(F.col(kind), n, kind) for n, kind in enumerate(KINDS)])
    df = df.withColumn("base", base)
    free = F.filter("more", lambda c: (F.length(c["value"]) > 0) & ~F.exists(
        "base", lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))
    free = _labelled(free, len(KINDS), None)
    seen = F.transform(F.concat("base", free), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        value_key(s["value"]).alias("value"), context(F.col("text"), s["start"]).alias("pattern")))
    return df.select("doc_id", "row", F.transform("base", lambda s: s.dropFields("value")).alias("base"),
                     seen.alias("seen"))


def confident_values(edges: DataFrame, support: float = SUPPORT, accept: float = ACCEPT,
                     rounds: int = ROUNDS) -> DataFrame:
    """value, kind: values found by patterns. `edges` has distinct (pattern, value, kind), kind null for candidates."""
    seeds = edges.filter("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")).withColumn(
        "trust", F.lit(1.0))
    links = written(edges.select("pattern", "value").distinct(), "links")
    unknown = written(links.join(seeds.select("value"), "value", "left_anti"), "unknown")
    sizes = links.groupBy("pattern").agg(F.count("*").alias("size"))
    known = written(seeds, "seeds")
    found = known.limit(0)
    for _ in range(rounds):
        held = links.join(known.unionAll(found), "value").groupBy("pattern", "kind").agg(F.sum("trust").alias("held"))
        scores = written(held.filter(F.col("held") >= support).join(sizes, "pattern").select(
            "pattern", "kind", (F.col("held") / F.col("size")).alias("score")), "scores")
        reached = unknown.join(scores, "pattern").groupBy("value", "kind").agg(F.sum("score").alias("got"))
        patterns = unknown.groupBy("value").agg(F.count("*").alias("patterns"))
        trust = reached.join(patterns, "value").select("value", "kind", (F.col("got") / F.col("patterns")).alias("trust"))
        best = trust.groupBy("value").agg(F.max(F.struct("trust", "kind")).alias("b"))
        found = written(best.select("value", "b.kind", "b.trust"), "found")
    return found.filter(F.col("trust") >= accept).select("value", "kind")


def personal_data(docs: DataFrame, support: float = SUPPORT, accept: float = ACCEPT,
                  rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, base and all (arrays of order, start, end, kind)."""
    read = written(_read(docs), "personal")
    seen = read.select("row", F.explode("seen").alias("s")).select("row", "s.*").filter(
        "pattern IS NOT NULL AND value <> ''")
    edges = written(seen.select("pattern", "value", "kind").distinct(), "edges")
    values = written(confident_values(edges, support, accept, rounds), "values")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = seen.filter("kind IS NULL").drop("kind").join(values, "value").groupBy("row").agg(
        F.collect_list(F.struct(order.alias("order"), "start", "end", "kind")).alias("added"))
    out = read.select("doc_id", "row", "base").join(added, "row", "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce(
        "added", F.array().cast("array<struct<order:int,start:int,end:int,kind:string>>")))).alias("all"))
