"""Text normalization as Column expressions. Only Unicode normalization forms leave the JVM, in whole Arrow arrays.

Missing values are empty strings throughout: every function takes null as "".
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import tables

#: What Python's \w leaves out: everything but letters, numbers, the underscore and white space. Marks go.
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def given(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def unicode_norm(c: Column, form: str = "NFKC") -> Column:
    """The text in a Unicode normalization form."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(given(c))


def lower_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(given(c)), r"(?U)\s+", " "))


def fold_punct(c: Column) -> Column:
    """`&` becomes `and`, other punctuation and underscores become spaces, runs of spaces become one."""
    spaced = F.regexp_replace(F.replace(given(c), F.lit("&"), F.lit(" and ")), f"(?U){NOT_WORD}", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)[_\s]+", " "))


def _mapped(words: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in words.items() for x in kv))


def tokens(c: Column) -> Column:
    return F.filter(F.split(given(c), " "), lambda x: x != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def basic(c: Column, unicode: bool = True) -> Column:
    """NFKC, folded punctuation, lower case. Without unicode the text is taken as normalized already."""
    return lower_ws(fold_punct(unicode_norm(c) if unicode else c))


def normalize_country(c: Column, unicode: bool = True) -> Column:
    plain = basic(c, unicode)
    return F.coalesce(F.element_at(_mapped(tables.COUNTRY_ALIASES), plain), plain)


def normalize_name(c: Column, unicode: bool = True) -> Column:
    return basic(c, unicode)


def normalize_address(c: Column, unicode: bool = True) -> Column:
    """The name's steps, then word by word: abbreviations, then the words for a house number."""
    words = _mapped(tables.ADDRESS_WORDS | {w: "house" for w in tables.HOUSE_WORDS})
    return joined(F.transform(tokens(basic(c, unicode)), lambda x: F.coalesce(F.element_at(words, x), x)))


def _alternatives(words: Iterable[str]) -> str:
    return "|".join(words)


def strip_terminal(name: Column, suffixes: Iterable[str], most: int = 3) -> Column:
    """A normalized name without up to `most` suffixes at its end."""
    one = _alternatives(suffixes)
    return F.regexp_replace(given(name), f"(?:(?:^| )(?:{one})){{1,{most}}}$", "")


def name_core(name: Column) -> Column:
    return strip_terminal(name, tables.LEGAL_SUFFIXES)


def compact(c: Column) -> Column:
    return F.replace(given(c), F.lit(" "), F.lit(""))


def _folds(limit: int = 384) -> tuple[str, str, dict[str, str]]:
    """(characters, their one-character folds, other folds) of Latin letters with marks below a code point."""
    one_from, one_to, other = "", "", {}
    for code in range(0x80, limit):
        fold = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if fold == chr(code):
            continue
        if len(fold) == 1:
            one_from, one_to = one_from + chr(code), one_to + fold
        else:
            other[chr(code)] = fold
    return one_from, one_to, other


def replaced(c: Column, table: dict[str, str], also: tuple[str, str] = ("", "")) -> Column:
    """Character by character: by a table of any strings and by a pair of strings of equal length."""
    one_from = also[0] + "".join(k for k, v in table.items() if len(v) == 1)
    one_to = also[1] + "".join(v for v in table.values() if len(v) == 1)
    gone = "".join(k for k, v in table.items() if not v)
    out = F.translate(c, one_from + gone, one_to)
    for k, v in table.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def transliterate(c: Column) -> Column:
    """A Latin view in lower case: Devanagari letters by a table, Latin letters without their marks."""
    one_from, one_to, other = _folds()
    latin = r"[\x{80}-\x{17F}\x{900}-\x{97F}]"
    return lower_ws(F.when(given(c).rlike(latin), replaced(given(c), tables.DEVANAGARI | other, (one_from, one_to))).otherwise(given(c)))


def transliterate_wide(c: Column) -> Column:
    """The second table: digits and dandas too, without lower case; never empty where the text isn't."""
    one_from, one_to, other = _folds()
    made = F.trim(F.regexp_replace(replaced(given(c), tables.DEVANAGARI_WIDE | other, (one_from, one_to)), r"(?U)\s+", " "))
    return F.when(made == "", given(c)).otherwise(made)


def has_non_latin(c: Column) -> Column:
    return given(c).rlike(r"[^\x00-\x7F]")


def ascii_fold(c: Column) -> Column:
    one_from, one_to, other = _folds()
    return replaced(given(c), other, (one_from, one_to))


def basic_clean(c: Column) -> Column:
    """Folded to plain Latin where that is below U+0180, lower case, punctuation to spaces."""
    return lower_ws(F.regexp_replace(F.replace(F.lower(ascii_fold(c)), F.lit("&"), F.lit(" and ")), f"(?U){NOT_WORD}|_", " "))


def expand(words: Column, table: dict[str, str]) -> Column:
    """Words with abbreviations written out, one word to any number of words."""
    full = _mapped(table)
    return F.flatten(F.transform(words, lambda x: F.split(F.coalesce(F.element_at(full, x), x), " ")))


def full_name(c: Column) -> Column:
    return joined(expand(tokens(basic_clean(c)), tables.NAME_EXPANSIONS))


def full_address(c: Column) -> Column:
    return joined(expand(tokens(basic_clean(c)), tables.ADDRESS_EXPANSIONS))


def full_core(name: Column) -> Column:
    """A normalized name without legal words anywhere; order and repeats stay."""
    return joined(F.filter(tokens(name), lambda x: ~x.isin(*tables.FULL_LEGAL_SUFFIXES)))


def full_core_compact(name: Column) -> Column:
    return strip_terminal(name, tables.FULL_LEGAL_SUFFIXES)


def combined_text(name: Column, address: Column) -> Column:
    return F.trim(F.concat_ws(" ", given(name), given(address)))


def view(**parts: Column) -> Column:
    """`query: name: ... address: ...` and the like, for encoders: label and value of each part that isn't blank."""
    return F.array_join(F.filter(F.array(*(F.when(given(v) != "", F.concat(F.lit(f"{k}: "), given(v))) for k, v in parts.items())), lambda x: x.isNotNull()), " ")


def semantic_text(*parts: Column, most: int = 2000) -> Column:
    """Parts that aren't blank, joined by ` [SEP] `, up to a number of characters."""
    return F.substring(F.array_join(F.filter(F.array(*map(given, parts)), lambda x: x != ""), " [SEP] "), 1, most)


def char_grams(c: Column, n: int = 3, pad: str = "#") -> Column:
    """Distinct character n-grams of a padded text; none for an empty one."""
    text = F.concat(F.lit(pad), given(c), F.lit(pad))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when((given(c) == "") | (F.length(text) < n), F.array().cast("array<string>")).otherwise(grams))
