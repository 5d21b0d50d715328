"""Vectors: hashed text features, cosine distance, text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 768


def features(text: Column) -> Column:
    """Words of a-z in lower case, and every word's 4-grams (a shorter word gives itself)."""
    small = F.lower(text)
    # A place begins a 4-gram, or it begins a whole word of fewer letters.
    grams = "(?=([a-z]{4}|(?<![a-z])[a-z]{1,3}(?![a-z])))"
    return F.concat(F.regexp_extract_all(small, F.lit("[a-z]+"), F.lit(0)), F.regexp_extract_all(small, F.lit(grams), F.lit(1)))


def bucket_and_sign(feature: Column, dim: int = DIM) -> tuple[Column, Column]:
    """The 128-bit MD5 number modulo dim (up to 32768), and +1 or -1 from its bit 64.

    The number is reduced in steps of at most 48 bits, so every step fits in a long.
    """
    digest = F.md5(feature)
    rest = F.lit(0).cast("bigint")
    for start, digits in ((1, 8), (9, 12), (21, 12)):
        word = F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
        rest = (rest * F.lit(1 << 4 * digits) + word) % F.lit(dim).cast("bigint")
    odd = F.substring(digest, 16, 1).isin(*"13579bdf")
    return rest, F.when(odd, 1).otherwise(-1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def vector_text(vector: Column) -> Column:
    """[x,y,...] with six decimals."""
    return F.concat(F.lit("["),
                    F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x)), ","),
                    F.lit("]"))
