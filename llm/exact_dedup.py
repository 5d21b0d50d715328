"""Exact duplicates by content-defined chunk recipes, in built-in functions only.

A text is cut where its own content says so (a sentence end or line break once a chunk is long enough),
so equal passages give equal chunks wherever they stand. Each distinct chunk moves once, to have its
64-bit identifier verified: a hash that two different chunks share gets a number as well. From then
on a document is its recipe, the ordered list of its chunk identifiers; documents are equal exactly
if their recipes are, and no document text is moved or compared again.

Null and empty texts are equal to each other. Rows with a null doc_id take part; they stay only if the
whole group has none. Repeated rows of one id share one fate. Columns other than doc_id and text are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import lower_ascii, written

# Up to a boundary after SHORTEST code points, else LONGEST of them, else what is left.
SHORTEST, LONGEST = 512, 4096


def chunk_pattern(shortest: int = SHORTEST, longest: int = LONGEST) -> str:
    return rf"(?s).{{{shortest},{longest}}}?(?<=[.!?;\n])|.{{1,{longest}}}"


def chunks_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))


def recipes(docs: DataFrame, pattern: str | None = None, bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and the recipe: `ids` (chunk hashes) and `extra` (numbers of chunks whose
    hash is not unique, by place). Equal recipes mean equal texts. Fewer `bits` force shared hashes."""
    pattern = pattern or chunk_pattern()
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", text.alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    plain = written(rows.select(
        "doc_id", digest,
        F.transform(chunks_of(F.col("text"), pattern), lambda c: chunk_hash(c, bits)).alias("ids")), "recipes")
    pieces = rows.select(digest, F.posexplode(chunks_of(F.col("text"), pattern)).alias("at", "chunk"))
    pieces = pieces.select("text_sha256", "at", "chunk", chunk_hash(F.col("chunk"), bits).alias("hash"))
    # The one movement of chunk texts: equal chunks meet (after map-side merging), then only counts move.
    dictionary = pieces.select("hash", "chunk").distinct()
    shared = written(dictionary.groupBy("hash").agg(F.count("*").alias("texts")).filter("texts > 1"), "shared")
    none = F.array().cast("array<struct<at:int,number:int>>")
    if shared.isEmpty():
        return plain.select("doc_id", "text_sha256", "ids", none.alias("extra"))
    unclear = pieces.join(shared, "hash", "left_semi")
    numbered = unclear.select("hash", "chunk").distinct().withColumn(
        "number", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
    # Equal texts have equal numbers, so the digest may stand for the row.
    extra = written(unclear.join(numbered, ["hash", "chunk"]).groupBy("text_sha256").agg(
        F.array_sort(F.collect_set(F.struct("at", "number"))).alias("extra")), "extra")
    return plain.join(extra, "text_sha256", "left").select(
        "doc_id", "text_sha256", "ids", F.coalesce("extra", none).alias("extra"))


def exact_duplicates(docs: DataFrame, pattern: str | None = None, bits: int = 64) -> DataFrame:
    """One row per document: keep_id is the largest doc_id among equal texts (A-Z lower-cased)."""
    known = recipes(docs, pattern, bits)
    # Written, so that the join below has two plain shuffles and a hot group can be split.
    groups = written(known.groupBy("ids", "extra").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return known.join(groups, ["ids", "extra"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")
