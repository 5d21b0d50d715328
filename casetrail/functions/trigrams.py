"""Trigram sets of normalised names.

A normalised name holds only a-z and spaces, so a trigram is one of 27^3 = 19,683 values. Matching
uses those as integers; `trigrams` gives the readable form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = 27
UNIVERSE = ALPHABET ** 3


@dataclass(frozen=True)
class Threshold:
    """A similarity bound as a fraction, compared in integers: equality counts as reached."""

    num: int
    den: int

    def reached(self, common: Column, size_a: Column, size_b: Column) -> Column:
        return common * (self.den + self.num) >= (size_a + size_b) * self.num

    def sizes_fit(self, size_a: Column, size_b: Column) -> Column:
        return (size_b * self.den >= size_a * self.num) & (size_a * self.den >= size_b * self.num)

    def prefix_length(self, size: Column) -> Column:
        """How many of the rarest trigrams must be looked at to miss nobody above the bound."""
        needed = F.floor((size * self.num + (self.den - 1)) / self.den)
        return (size - needed + 1).cast("int")


def trigrams(name: Column) -> Column:
    """Distinct 3-grams of each word, padded with two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.regexp_replace(F.trim(name), " +", "   "), F.lit(" "))
    # Every place that begins three characters of one padded word: no two spaces at the end.
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(..[^ ]|.[^ ] ))"), F.lit(1)))


def trigram_codes(name: Column) -> Column:
    """The trigram set as integers below UNIVERSE."""
    def letter(gram: Column, at: int) -> Column:
        return F.greatest(F.ascii(F.substring(gram, at, 1)) - 96, F.lit(0))

    return F.transform(
        trigrams(name),
        lambda g: (letter(g, 1) * ALPHABET + letter(g, 2)) * ALPHABET + letter(g, 3))


def similarity(set_a: Column, set_b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 when a set is empty."""
    common = F.size(F.array_intersect(set_a, set_b))
    either = F.size(set_a) + F.size(set_b) - common
    return F.when((F.size(set_a) > 0) & (F.size(set_b) > 0), common / either).otherwise(F.lit(0.0))
