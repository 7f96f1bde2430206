"""The two record normalizers, each as one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import numbers, text


def spec(records: DataFrame, unicode: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, country_norm, name_*, address_*, house_number, numeric_*, postal_candidate, address_missing and tokens.

    Missing values count as "". Numbers come from the raw name and address, one after the other. Without unicode the
    Arrow step for NFKC is left out, for text that is known to be in that form. Columns in keep stay.
    """
    name, address = text.given(F.col("business_name")), text.given(F.col("business_address"))
    both = F.concat(name, F.lit(" "), address)
    base = records.select(
        F.col("entity_id"),
        *keep,
        text.normalize_country(F.col("country"), unicode).alias("country_norm"),
        name.alias("name_raw"),
        address.alias("address_raw"),
        text.normalize_name(F.col("business_name"), unicode).alias("name_norm"),
        text.normalize_address(F.col("business_address"), unicode).alias("address_norm"),
        numbers.house_number(both).alias("house_number"),
        numbers.numeric_tokens(both).alias("numeric_tokens"),
        numbers.postal_candidate(both).alias("postal_candidate"),
        (F.trim(address) == "").cast("int").alias("address_missing"),
    )
    n, a = F.col("name_norm"), F.col("address_norm")
    return base.withColumns(
        {
            "name_translit": text.transliterate(n),
            "name_core": text.name_core(n),
            "name_compact": text.compact(n),
            "name_tokens": text.tokens(n),
            "address_translit": text.transliterate(a),
            "address_compact": text.compact(a),
            "address_tokens": text.tokens(a),
            "numeric_signature": numbers.signature(F.col("numeric_tokens")),
        }
    )


LEAN = ("entity_id", "country_norm", "name_norm", "name_translit", "name_core", "name_compact", "address_norm", "address_translit", "address_compact", "house_number", "numeric_tokens", "numeric_signature", "postal_candidate", "address_missing")


def lean(normalized: DataFrame) -> DataFrame:
    """The columns that a cache keeps."""
    return normalized.select(*LEAN)


def full(records: DataFrame) -> DataFrame:
    """The second normalizer: Latin folding instead of NFKC, abbreviations written out, lists of house numbers."""
    name, address = text.given(F.col("business_name")), text.given(F.col("business_address"))
    base = records.select(
        "entity_id",
        F.lower(text.normalize_country(text.ascii_fold(F.col("country")), unicode=False)).alias("country_norm"),
        name.alias("name_raw"),
        address.alias("address_raw"),
        text.full_name(name).alias("name_norm"),
        text.full_address(address).alias("address_norm"),
        numbers.house_numbers(F.concat(name, F.lit(" "), address)).alias("house_numbers"),
        numbers.numeric_tokens(F.concat(name, F.lit(" "), address)).alias("numeric_tokens"),
        numbers.postal_candidates(address).alias("postal_candidates"),
        (F.trim(address) == "").cast("int").alias("address_missing"),
    )
    n = F.col("name_norm")
    return base.withColumns(
        {
            "name_translit": text.transliterate_wide(n),
            "name_core": text.full_core(n),
            "name_compact": text.full_core_compact(n),
            "name_tokens": text.tokens(n),
            "address_tokens": text.tokens(F.col("address_norm")),
            "address_compact": F.trim(F.regexp_replace("address_norm", r"\s+", " ")),
            "combined_text": text.combined_text(n, F.col("address_norm")),
        }
    )
