"""Pair features of three recipes as Column expressions over sides' columns *_1 and *_2.

With fuzzy=False every fuzzy ratio is the word Jaccard similarity, and all features stay in generated code. With
fuzzy=True the ratios are Arrow functions; they come after the top-K limit, so only kept pairs reach Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import fuzzy as fz
from ravelin.functions import text
from ravelin.functions.similarity import differ, jaccard, length_ratio, same


def _both(name: str) -> tuple[Column, Column]:
    return F.col(f"{name}_1"), F.col(f"{name}_2")


def _ratio(kind: str, name: str, fuzzy: bool, tokens: str) -> Column:
    if not fuzzy:
        return jaccard(*_both(tokens))
    made = {"ratio": fz.ratio_column, "sort": fz.token_sort_column, "set": fz.token_set_column, "partial": fz.partial_column, "weighted": fz.weighted_column}
    return made[kind](*_both(name)) / 100


def name_features(fuzzy: bool = False) -> dict[str, Column]:
    return {
        "name_exact": same(*_both("name_norm")),
        "name_translit_exact": same(*_both("name_translit")),
        "name_core_exact": same(*_both("name_core")),
        "name_compact_exact": same(*_both("name_compact")),
        "name_ratio": _ratio("ratio", "name_norm", fuzzy, "name_tokens"),
        "name_sort_ratio": _ratio("sort", "name_norm", fuzzy, "name_tokens"),
        "name_set_ratio": _ratio("set", "name_norm", fuzzy, "name_tokens"),
        "name_weighted_ratio": _ratio("weighted", "name_norm", fuzzy, "name_tokens"),
        "name_jaccard": jaccard(*_both("name_tokens")),
        "name_length_ratio": length_ratio(*_both("name_norm")),
    }


def address_features(fuzzy: bool = False) -> dict[str, Column]:
    return {
        "address_exact": same(*_both("address_norm")),
        "address_translit_exact": same(*_both("address_translit")),
        "address_ratio": _ratio("ratio", "address_norm", fuzzy, "address_tokens"),
        "address_set_ratio": _ratio("set", "address_norm", fuzzy, "address_tokens"),
        "address_jaccard": jaccard(*_both("address_tokens")),
        "address_length_ratio": length_ratio(*_both("address_norm")),
    }


def number_features() -> dict[str, Column]:
    a, b = _both("numeric_tokens")
    return {
        "house_exact": same(*_both("house_number")),
        "house_normalized_exact": same(*_both("house_number")),
        "house_conflict": differ(*_both("house_number")),
        "postal_exact": same(*_both("postal_candidate")),
        "postal_conflict": differ(*_both("postal_candidate")),
        "numeric_shared": F.size(F.array_intersect(a, b)),
        "numeric_jaccard": jaccard(a, b, both_empty=0.0),
        "numeric_conflict": ((F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) == 0)).cast("int"),
        "address_missing_1": F.col("address_missing_1"),
        "address_missing_2": F.col("address_missing_2"),
        "house_missing": ((F.col("house_number_1") == "") | (F.col("house_number_2") == "")).cast("int"),
    }


def semantic_features() -> dict[str, Column]:
    return {
        "dense_cosine": F.coalesce("ann_score", F.lit(0.0)),
        "ann_rank": F.coalesce("ann_rank", F.lit(99)),
        "ann_hit": F.coalesce("hit_ann", F.lit(False)).cast("int"),
        "shared_block_count": F.coalesce("block_count", F.lit(0)).cast("int"),
    }


def rare_features(idf: str | None = None) -> dict[str, Column]:
    """Shared tokens of name and address: their number, or the sum of a map column's weights where one is given."""

    def value(tokens: str) -> Column:
        shared = F.array_intersect(*_both(tokens))
        if idf is None:
            return F.size(shared).cast("double")
        return F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(F.col(idf), t), F.lit(0.0)))

    return {"rare_name_overlap": value("name_tokens"), "rare_address_overlap": value("address_tokens")}


def structure_features() -> dict[str, Column]:
    return {
        "target_source": (F.substring_index("target_id", "-", 1) == "S3").cast("int"),
        "family_size": F.least(F.coalesce("family", F.lit(1)), F.lit(10)).cast("int"),
        "siblings": F.greatest(F.coalesce("family", F.lit(1)) - 1, F.lit(0)).cast("int"),
    }


def spec_features(fuzzy: bool = False) -> dict[str, Column]:
    """The 36 features, in their order."""
    return name_features(fuzzy) | address_features(fuzzy) | number_features() | semantic_features() | rare_features() | structure_features()


SPEC_ORDER = (
    "name_exact", "name_translit_exact", "name_core_exact", "name_compact_exact", "name_ratio", "name_sort_ratio", "name_set_ratio", "name_weighted_ratio",
    "name_jaccard", "name_length_ratio", "address_exact", "address_translit_exact", "address_ratio", "address_set_ratio", "address_jaccard",
    "address_length_ratio", "house_exact", "house_normalized_exact", "house_conflict", "postal_exact", "postal_conflict", "numeric_shared",
    "numeric_jaccard", "numeric_conflict", "address_missing_1", "address_missing_2", "house_missing", "dense_cosine", "ann_rank", "ann_hit",
    "shared_block_count", "rare_name_overlap", "rare_address_overlap", "target_source", "family_size", "siblings",
)


def light_features(fuzzy: bool = False) -> dict[str, Column]:
    """The 26 features of the token recipe, over the second normalizer's sides."""
    n1, n2 = _both("name_norm")
    a1, a2 = _both("address_norm")
    return {
        "name_exact": same(n1, n2),
        "name_core_exact": same(*_both("name_core")),
        "name_compact_exact": same(*_both("name_compact")),
        "name_ratio": _ratio("ratio", "name_norm", fuzzy, "name_tokens"),
        "name_sort": _ratio("sort", "name_norm", fuzzy, "name_tokens"),
        "name_set": _ratio("set", "name_norm", fuzzy, "name_tokens"),
        "name_partial": _ratio("partial", "name_norm", fuzzy, "name_tokens"),
        "name_jaccard": jaccard(*_both("name_tokens")),
        "name_trigram": jaccard(text.char_grams(n1), text.char_grams(n2)),
        "name_length_ratio": length_ratio(n1, n2),
        "address_exact": same(a1, a2),
        "address_ratio": _ratio("ratio", "address_norm", fuzzy, "address_tokens"),
        "address_sort": _ratio("sort", "address_norm", fuzzy, "address_tokens"),
        "address_set": _ratio("set", "address_norm", fuzzy, "address_tokens"),
        "address_jaccard": jaccard(*_both("address_tokens")),
        "address_trigram": jaccard(text.char_grams(a1), text.char_grams(a2)),
        "address_length_ratio": length_ratio(a1, a2),
        "numeric_jaccard": jaccard(*_both("numeric_tokens"), both_empty=0.0),
        "numeric_shared": F.size(F.array_intersect(*_both("numeric_tokens"))),
        "postal_overlap": F.arrays_overlap(*_both("postal_candidates")).cast("int"),
        "house_overlap": F.arrays_overlap(*_both("house_numbers")).cast("int"),
        "country_same": same(*_both("country_norm")),
        "address_missing_1": F.col("address_missing_1"),
        "address_missing_2": F.col("address_missing_2"),
        "target_source": (F.substring_index("target_id", "-", 1) == "S3").cast("int"),
        "bscore": F.coalesce("bscore", F.lit(0.0)),
    }


def basic_features() -> dict[str, Column]:
    n1, n2 = _both("name_norm")
    a1, a2 = _both("address_norm")
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]"))
    return {
        "name_len_1": F.length(n1), "name_len_2": F.length(n2), "name_len_gap": F.abs(F.length(n1) - F.length(n2)),
        "name_words_1": F.size("name_tokens_1"), "name_words_2": F.size("name_tokens_2"), "name_words_gap": F.abs(F.size("name_tokens_1") - F.size("name_tokens_2")),
        "address_len_1": F.length(a1), "address_len_2": F.length(a2), "address_len_gap": F.abs(F.length(a1) - F.length(a2)),
        "address_words_1": F.size("address_tokens_1"), "address_words_2": F.size("address_tokens_2"),
        "digits_1": digits(F.concat(n1, a1)), "digits_2": digits(F.concat(n2, a2)), "country_same": same(*_both("country_norm")),
    }


def lexical_features(fuzzy: bool = False) -> dict[str, Column]:
    n1, n2 = _both("name_norm")
    a1, a2 = _both("address_norm")
    out = {f"name_{k}": _ratio(k, "name_norm", fuzzy, "name_tokens") for k in ("ratio", "sort", "set", "partial", "weighted")}
    out |= {f"address_{k}": _ratio(k, "address_norm", fuzzy, "address_tokens") for k in ("ratio", "sort", "set", "partial", "weighted")}
    t1, t2 = text.tokens(F.col("name_translit_1")), text.tokens(F.col("name_translit_2"))
    return out | {
        "name_jaccard": jaccard(*_both("name_tokens")),
        "address_jaccard": jaccard(*_both("address_tokens")),
        "name_trigram": jaccard(text.char_grams(n1), text.char_grams(n2)),
        "address_trigram": jaccard(text.char_grams(a1), text.char_grams(a2)),
        "translit_ratio": fz.ratio_column(*_both("name_translit")) / 100 if fuzzy else jaccard(t1, t2),
        "core_exact": same(*_both("name_core")),
        "compact_exact": same(*_both("name_compact")),
        "name_exact": same(n1, n2),
    }


def address_detail_features() -> dict[str, Column]:
    a1, a2 = _both("address_norm")
    letters = lambda c: F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")
    return {
        "address_token_jaccard": jaccard(*_both("address_tokens")),
        "address_char_jaccard": jaccard(letters(a1), letters(a2)),
        "digit_jaccard": jaccard(*_both("numeric_tokens"), both_empty=0.0),
        "postal_same": same(*_both("postal_candidate")),
        "postal_conflict": differ(*_both("postal_candidate")),
        "house_same": same(*_both("house_number")),
        "house_conflict": differ(*_both("house_number")),
        "address_both_given": ((a1 != "") & (a2 != "")).cast("int"),
    }


EVIDENCE = ("exact_name", "exact_address", "rare_name", "rare_address", "numeric", "char", "transliterated", "e5_name", "e5_address")


def block_features() -> dict[str, Column]:
    """Nine evidence flags, channel support, best rank and score, and the share of channels."""
    return {k: F.coalesce(k, F.lit(0)).cast("int") for k in EVIDENCE} | {
        "block_support": F.coalesce("n", F.lit(1)).cast("int"),
        "best_rank": F.coalesce("best_rank", F.lit(999)).cast("int"),
        "best_score": F.coalesce("best_score", F.lit(0.0)),
        "bscore": F.coalesce("bscore", F.lit(0.0)),
    }


def e5_features() -> dict[str, Column]:
    return {k: F.coalesce(k, F.lit(0.0)) for k in ("e5_name_score", "e5_full_score", "e5_max", "e5_mean", "e5_gap")}


def entity_features(pairs: DataFrame, score: str = "bscore") -> DataFrame:
    """pairs with their place among an S1's candidates: rank (ties share one), gap to the best, numbers of candidates and
    of strong ones (half the best score and more), and how many channels an S1's candidates come from."""
    by_s1 = Window.partitionBy("s1_id")
    best = F.max(score).over(by_s1)
    return pairs.withColumns(
        {
            "cand_rank": F.rank().over(by_s1.orderBy(F.desc(score))),
            "score_gap": best - F.col(score),
            "n_cands": F.count("*").over(by_s1).cast("int"),
            "n_strong": F.sum((F.col(score) >= 0.5 * best).cast("int")).over(by_s1).cast("int"),
            "evidence_diversity": F.size(F.array_distinct(F.flatten(F.collect_set("blocks").over(by_s1)))),
        }
    )


def with_features(pairs: DataFrame, features: dict[str, Column], keep: tuple[str, ...] = ("s1_id", "target_id")) -> DataFrame:
    return pairs.select(*keep, *(c.alias(k) for k, c in features.items()))
