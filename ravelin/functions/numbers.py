"""Numbers in names and addresses, by regular expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.text import given

# Patterns that must find what the matched engine finds. Digits are those of any script, as in Python.
HOUSE = (
    r"(?i)(?U)\b(?:h\.?\s*no\.?|house\s*no\.?|no\.?|#|plot|shop|unit|flat|apt\.?)?\s*"
    r"(\d{1,6}[A-Za-z]?(?:\s*[/\-]\s*\d{1,6}[A-Za-z]?)?)"
)
LETTER_HOUSE = r"(?i)(?U)\b([A-Za-z]{1,4})[\-\s]?0*(\d{1,6}[A-Za-z]?)\b"
FRACTION = r"(\p{Nd}+)\s*/\s*(\p{Nd}+)"
PIN = r"(?<!\p{Nd})(\p{Nd}{6})(?!\p{Nd})"
ZIP = r"(?<!\p{Nd})(\p{Nd}{5})(?:-\p{Nd}{4})?(?!\p{Nd})"
HOUSE_WORD = r"(?<![\p{L}\p{N}_])(\p{Nd}{1,6}[a-zA-Z]?(?:[/-]\p{Nd}{1,6}[a-zA-Z]?)?)(?![\p{L}\p{N}_])"


def canon_house(c: Column) -> Column:
    """Lower case without spaces, hyphens, slashes and leading zeros before a digit."""
    return F.regexp_replace(F.regexp_replace(F.lower(given(c)), r"[\s\-/]+", ""), r"^0+(?=\d)", "")


def numeric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(given(c), F.lit(r"(\p{Nd}+)"), F.lit(1))


def signature(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), "|")


def postal_candidates(c: Column) -> Column:
    """Isolated six- and five-digit numbers, distinct, in order."""
    pins = F.regexp_extract_all(given(c), F.lit(PIN), F.lit(1))
    zips = F.regexp_extract_all(given(c), F.lit(ZIP), F.lit(1))
    return F.array_sort(F.array_union(pins, zips))


def postal_candidate(c: Column) -> Column:
    return F.coalesce(F.array_min(postal_candidates(c)), F.lit(""))


def fractions(c: Column) -> Column:
    return F.regexp_extract_all(given(c), F.lit(FRACTION), F.lit(0))


def house_number(c: Column) -> Column:
    """The first house-like number; else the first letter-and-digits id with a digit other than zero."""
    plain = canon_house(F.regexp_extract(given(c), HOUSE, 1))
    letters = F.regexp_extract_all(given(c), F.lit(LETTER_HOUSE), F.lit(1))
    digits = F.regexp_extract_all(given(c), F.lit(LETTER_HOUSE), F.lit(2))
    ids = F.filter(F.zip_with(letters, digits, lambda a, d: F.when(F.btrim(d, F.lit("0")) != "", F.concat(a, d))), lambda x: x.isNotNull())
    return F.when(plain != "", plain).otherwise(canon_house(F.coalesce(F.get(ids, 0), F.lit(""))))


def house_numbers(c: Column, most: int = 8) -> Column:
    return F.slice(F.regexp_extract_all(given(c), F.lit(HOUSE_WORD), F.lit(1)), 1, most)


def pin_boosters(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(given(c), F.lit(r"(\p{Nd}{5,6})"), F.lit(1)))


def pattern_flags(c: Column) -> dict[str, Column]:
    """Has the text a number of 4, 5 or 6 digits, a phone number, a mail address, a link, a house number?"""
    text = given(c)
    return {
        "has_4": text.rlike(r"(?<!\d)\d{4}(?!\d)"),
        "has_5": text.rlike(r"(?<!\d)\d{5}(?!\d)"),
        "has_6": text.rlike(r"(?<!\d)\d{6}(?!\d)"),
        "has_phone": text.rlike(r"\+?\d[\d ()-]{8,}\d"),
        "has_email": text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"),
        "has_url": text.rlike(r"https?://"),
        "has_house": text.rlike(r"(?i)(no|house|plot|flat)[. ]*\d"),
    }
