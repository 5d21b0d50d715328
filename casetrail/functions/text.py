"""Normal forms of names and phones, display forms, ids found in free text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that are not part of a name.
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "prof", "mama", "baba", "rev"]

# Evidence ids (account opening, transfer, login, sanctions entry, note), account ids;
# the digits shown are the least.
EVIDENCE_ID = r"\b(KYC-\d{6,}|T\d{7,}|L\d{7,}|S-\d{3,}|N-\d{5,})\b"
ACCOUNT_ID = r"\bA\d{6,}\b"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition as arguments for translate(), plus one-to-many expansions.

    Built from the Unicode data of the driver: characters that decompose to one ASCII letter are
    mapped, combining marks are deleted (no counterpart in the second string), and characters that
    decompose to several characters with a letter among them go to the expansion map.
    """
    mapped, target, deleted, expanded = [], [], [], {}
    for code in range(0x80, 0x30000):   # no character beyond has a decomposition or combines
        ch = chr(code)
        if unicodedata.combining(ch):
            deleted.append(ch)
            continue
        if not unicodedata.decomposition(ch):
            continue
        base = [c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)]
        plain = "".join(c if c.isascii() and c.isalpha() else " " for c in base)
        if not plain.strip():
            continue
        if len(plain) == 1:
            mapped.append(ch)
            target.append(plain)
        else:
            expanded[ch] = plain
    return "".join(mapped + deleted), "".join(target), expanded


def fold_accents(col: Column) -> Column:
    """Letters in compatibility-decomposed form, without combining marks."""
    source, target, expanded = _fold_tables()
    pairs = F.str_to_map(F.lit("|".join(f"{k}={v}" for k, v in expanded.items())), F.lit("[|]"), F.lit("="))
    spelled = F.array_join(
        F.transform(F.split(col, ""), lambda c: F.coalesce(pairs[c], c)), "")
    # Expansions are rare: the per-character path runs only for values that hold one. The long class is asked of the
    # characters beyond ASCII alone, as each costs a comparison with every member.
    beyond = F.regexp_replace(col, "[\\x00-\\x7F]+", "")
    spelled = F.when(beyond.rlike("[" + "".join(expanded) + "]"), spelled).otherwise(col)
    return F.when(col.rlike("[^\\x00-\\x7F]"), F.translate(spelled, source, target)).otherwise(col)


def normalise_name(col: Column) -> Column:
    """Lower-case ASCII words joined by single spaces, titles dropped."""
    folded = F.lower(F.regexp_replace(fold_accents(F.coalesce(col, F.lit(""))), "[^A-Za-z]+", " "))
    # Words stand behind one space each; a title goes with its space.
    titles = f" (?:{'|'.join(HONORIFICS)})(?= |$)"
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), folded), titles, ""))


def normalise_phone(col: Column) -> Column:
    """South African mobile number as +27 and nine digits; null when it is not one."""
    digits = F.regexp_replace(col, r"\D", "")
    national = F.regexp_extract(digits, r"^(?:27|0)([678]\d{8})$", 1)
    return F.when(national != "", F.concat(F.lit("+27"), national))


def title_case(col: Column) -> Column:
    """A capital after every non-letter, the other letters small."""
    parts = F.split(col, r"(?<=[^\p{L}])")
    return F.array_join(F.transform(parts, F.initcap), "")


def found_ids(col: Column, pattern: str, group: int = 0) -> Column:
    """Distinct ids in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col, F.lit(pattern), F.lit(group))))


def evidence_ids_in(col: Column) -> Column:
    return found_ids(col, EVIDENCE_ID, 1)


def account_ids_in(col: Column) -> Column:
    return found_ids(col, ACCOUNT_ID)
