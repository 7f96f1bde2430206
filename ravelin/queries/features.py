"""Pair features of the three recipes, first in their plain form, which SQL can follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import tables as word_lists
from ravelin.functions import text
from ravelin.operators import blocking, candidates, features, metrics, normalize
from ravelin.queries.base import both_sides, query, sql_basic, sql_jaccard, sql_map, sql_strip, sql_tokens
from ravelin.queries.blocking import ranked_pairs
from ravelin.sources import roles


def _plain(pairs: DataFrame, made: dict[str, Column], places: int = 6) -> DataFrame:
    """All features as rounded doubles, so that both engines print the same."""
    return pairs.select("s1_id", "target_id", *(F.round(c.cast("double"), places).alias(k) for k, c in made.items()))


def _j(name: str, empty: str = "1.0") -> str:
    return sql_jaccard(f"{name}_1", f"{name}_2", empty)


def _sql(columns: dict[str, str], source: str = "ranked WHERE block_rank < 22", places: int = 6) -> str:
    return "SELECT s1_id, target_id, " + ", ".join(f"round(CAST({v} AS DOUBLE), {places}) AS {k}" for k, v in columns.items()) + f" FROM {source}"


_eq = lambda n: f"CAST({n}_1 <> '' AND {n}_1 = {n}_2 AS INT)"
_ne = lambda n: f"CAST({n}_1 <> '' AND {n}_2 <> '' AND {n}_1 <> {n}_2 AS INT)"
_len = lambda n: f"least(length({n}_1), length({n}_2)) / CAST(greatest(length({n}_1), length({n}_2)) + 1 AS DOUBLE)"
_shared = lambda n: f"len(list_intersect(list_distinct({n}_1), list_distinct({n}_2)))"

_NAME = {"name_exact": _eq("name_norm"), "name_translit_exact": _eq("name_translit"), "name_core_exact": _eq("name_core"), "name_compact_exact": _eq("name_compact")}
_NAME |= {k: _j("name_tokens") for k in ("name_ratio", "name_sort_ratio", "name_set_ratio", "name_weighted_ratio", "name_jaccard")} | {"name_length_ratio": _len("name_norm")}
_ADDRESS = {"address_exact": _eq("address_norm"), "address_translit_exact": _eq("address_translit")}
_ADDRESS |= {k: _j("address_tokens") for k in ("address_ratio", "address_set_ratio", "address_jaccard")} | {"address_length_ratio": _len("address_norm")}
_NUMBERS = {
    "house_exact": _eq("house_number"), "house_normalized_exact": _eq("house_number"), "house_conflict": _ne("house_number"), "postal_exact": _eq("postal_candidate"),
    "postal_conflict": _ne("postal_candidate"), "numeric_shared": _shared("numeric_tokens"), "numeric_jaccard": _j("numeric_tokens", "0.0"),
    "numeric_conflict": f"CAST(len(numeric_tokens_1) > 0 AND len(numeric_tokens_2) > 0 AND {_shared('numeric_tokens')} = 0 AS INT)",
    "address_missing_1": "address_missing_1", "address_missing_2": "address_missing_2", "house_missing": "CAST(house_number_1 = '' OR house_number_2 = '' AS INT)",
}
_SEMANTIC = {"dense_cosine": "0.0", "ann_rank": "99", "ann_hit": "0", "shared_block_count": "block_count"}
_RARE = {"rare_name_overlap": _shared("name_tokens"), "rare_address_overlap": _shared("address_tokens")}


@query("fea2_name", _sql(_NAME))
def name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows, features.name_features()))


@query("fea3_address", _sql(_ADDRESS))
def address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows, features.address_features()))


@query("fea4_numbers", _sql(_NUMBERS))
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows, features.number_features()))


@query("fea5_semantic", _sql(_SEMANTIC))
def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows, features.semantic_features()))


@query("fea6_rare_overlap", _sql(_RARE))
def rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows, features.rare_features()))


_FAMILY = "fam AS (SELECT entity_id AS fid, count(*) OVER (PARTITION BY country_norm, CASE WHEN name_core <> '' THEN name_core ELSE name_translit END, address_compact) AS family FROM tg)"
_STRUCTURE = {"target_source": "CAST(target_id LIKE 'S3-%' AS INT)", "family_size": "least(family, 10)", "siblings": "greatest(family - 1, 0)"}


def _with_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, targets = both_sides(spark, sf_dir)
    return ranked_pairs(spark, sf_dir).join(blocking.family_counts(targets).withColumnRenamed("id", "target_id"), "target_id", "left")


@query("fea7_structure", f"WITH {_FAMILY} {_sql(_STRUCTURE, '(SELECT * FROM ranked WHERE block_rank < 22) r JOIN fam ON r.target_id = fam.fid')}")
def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_with_family(spark, sf_dir), features.structure_features())


@query("fea8_all_36", f"WITH {_FAMILY} {_sql(_NAME | _ADDRESS | _NUMBERS | _SEMANTIC | _RARE | _STRUCTURE, '(SELECT * FROM ranked WHERE block_rank < 22) r JOIN fam ON r.target_id = fam.fid')}")
def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_with_family(spark, sf_dir), features.spec_features())


def _full_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with an equal core name in the second normalizer's records."""
    rows = normalize.full(roles.records(spark, sf_dir))
    s1, targets = roles.split(rows)
    keyed = lambda r, n: r.select(F.col("entity_id").alias(n), "country_norm", "name_core")
    found = keyed(s1, "s1_id").join(keyed(targets, "target_id"), ["country_norm", "name_core"]).select("s1_id", "target_id")
    columns = ("name_norm", "name_translit", "name_core", "name_compact", "name_tokens", "address_norm", "address_tokens", "house_numbers", "numeric_tokens", "postal_candidates", "address_missing", "country_norm")
    return candidates.sides(found, s1, targets, columns)


_both_lists = lambda n: f"len(list_intersect({n}_1, {n}_2)) > 0"
_HOUSES = r"list_filter(regexp_extract_all(' ' || regexp_replace(business_name || ' ' || business_address, '([, .])', '\1\1', 'g') || ' ', '[ ,.]([0-9]{1,6}[a-zA-Z]?(?:[/-][0-9]{1,6}[a-zA-Z]?)?)[ ,.]', 1), lambda w: w <> '')[1:8]"
_LEGAL = ", ".join(f"'{w}'" for w in word_lists.FULL_LEGAL_SUFFIXES)
_FULL = f"""f0 AS (SELECT r.entity_id, n.country_norm, array_to_string(list_transform({sql_tokens(sql_basic('business_name'))}, lambda w: {sql_map('w', word_lists.NAME_EXPANSIONS)}), ' ') AS name_norm,
  array_to_string(list_transform({sql_tokens(sql_basic('business_address'))}, lambda w: {sql_map('w', word_lists.ADDRESS_EXPANSIONS)}), ' ') AS address_norm, {_HOUSES} AS house_numbers, n.numeric_tokens,
  list_sort(list_distinct(list_filter(regexp_extract_all(business_address, '(\\d+)', 1), lambda w: length(w) IN (5, 6)))) AS postal_candidates, n.address_missing FROM records r JOIN norm n ON r.entity_id = n.entity_id),
f AS MATERIALIZED (SELECT *, array_to_string(list_filter({sql_tokens('name_norm')}, lambda w: w NOT IN ({_LEGAL})), ' ') AS name_core, {sql_strip('name_norm', word_lists.FULL_LEGAL_SUFFIXES)} AS name_compact, {sql_tokens('name_norm')} AS name_tokens, {sql_tokens('address_norm')} AS address_tokens FROM f0),
fp AS (SELECT a.entity_id AS s1_id, b.entity_id AS target_id, {', '.join(f'a.{c} AS {c}_1, b.{c} AS {c}_2' for c in ('name_norm', 'name_core', 'name_compact', 'name_tokens', 'address_norm', 'address_tokens', 'house_numbers', 'numeric_tokens', 'postal_candidates', 'address_missing', 'country_norm'))}
  FROM f a JOIN f b ON a.country_norm = b.country_norm AND a.name_core = b.name_core WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%')"""
_grams9 = lambda n: f"CASE WHEN {n} = '' THEN [] ELSE list_distinct(list_transform(range(1, length('#' || {n} || '#') - 1), lambda i: substr('#' || {n} || '#', i, 3))) END"
_LIGHT = {"name_exact": _eq("name_norm"), "name_core_exact": _eq("name_core"), "name_compact_exact": _eq("name_compact")} | {f"name_{k}": _j("name_tokens") for k in ("ratio", "sort", "set", "partial", "jaccard")}
_LIGHT |= {"name_trigram": sql_jaccard(_grams9("name_norm_1"), _grams9("name_norm_2")), "name_length_ratio": _len("name_norm"), "address_exact": _eq("address_norm")}
_LIGHT |= {f"address_{k}": _j("address_tokens") for k in ("ratio", "sort", "set", "jaccard")} | {"address_trigram": sql_jaccard(_grams9("address_norm_1"), _grams9("address_norm_2")), "address_length_ratio": _len("address_norm")}
_LIGHT |= {
    "numeric_jaccard": _j("numeric_tokens", "0.0"), "numeric_shared": _shared("numeric_tokens"), "postal_overlap": f"CAST({_both_lists('postal_candidates')} AS INT)", "house_overlap": f"CAST({_both_lists('house_numbers')} AS INT)",
    "country_same": _eq("country_norm"), "address_missing_1": "address_missing_1", "address_missing_2": "address_missing_2", "target_source": "CAST(target_id LIKE 'S3-%' AS INT)", "bscore": "0.0",
}


@query("fea9_light_26", f"WITH {_FULL} {_sql(_LIGHT, 'fp')}")
def light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_full_pairs(spark, sf_dir).withColumn("bscore", F.lit(None).cast("double")), features.light_features())


@query("fea9_light_26_fuzzy")
def light_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(blocking.spread(_full_pairs(spark, sf_dir), "s1_id").withColumn("bscore", F.lit(None).cast("double")), features.light_features(fuzzy=True))


_digits = lambda n: f"length(regexp_replace(concat(name_norm_{n}, address_norm_{n}), '[^0-9]', '', 'g'))"
_BASIC = {
    "name_len_1": "length(name_norm_1)", "name_len_2": "length(name_norm_2)", "name_len_gap": "abs(length(name_norm_1) - length(name_norm_2))",
    "name_words_1": "len(name_tokens_1)", "name_words_2": "len(name_tokens_2)", "name_words_gap": "abs(len(name_tokens_1) - len(name_tokens_2))",
    "address_len_1": "length(address_norm_1)", "address_len_2": "length(address_norm_2)", "address_len_gap": "abs(length(address_norm_1) - length(address_norm_2))",
    "address_words_1": "len(address_tokens_1)", "address_words_2": "len(address_tokens_2)", "digits_1": _digits(1), "digits_2": _digits(2), "country_same": _eq("country_norm"),
}


@query("fea10_basic_14", _sql(_BASIC))
def basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows, features.basic_features()))


_grams = lambda n: f"list_distinct(list_transform(range(1, length('#' || {n} || '#') - 1), lambda i: substr('#' || {n} || '#', i, 3)))"
_gram_or = lambda n: f"CASE WHEN {n} = '' THEN [] ELSE {_grams(n)} END"
_LEXICAL = {f"name_{k}": _j("name_tokens") for k in ("ratio", "sort", "set", "partial", "weighted")} | {f"address_{k}": _j("address_tokens") for k in ("ratio", "sort", "set", "partial", "weighted")}
_LEXICAL |= {
    "name_jaccard": _j("name_tokens"), "address_jaccard": _j("address_tokens"), "name_trigram": sql_jaccard(_gram_or("name_norm_1"), _gram_or("name_norm_2")),
    "address_trigram": sql_jaccard(_gram_or("address_norm_1"), _gram_or("address_norm_2")), "translit_ratio": _j("name_tokens"), "core_exact": _eq("name_core"),
    "compact_exact": _eq("name_compact"), "name_exact": _eq("name_norm"),
}


@query("fea11_lexical_18", _sql(_LEXICAL))
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows, features.lexical_features()))


@query("fea11_lexical_18_fuzzy")
def lexical_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(blocking.spread(rows, "s1_id"), features.lexical_features(fuzzy=True)))


_chars = lambda n: f"list_filter(string_split({n}, ''), lambda w: w <> '')"
_DETAIL = {
    "address_token_jaccard": _j("address_tokens"), "address_char_jaccard": sql_jaccard(_chars("address_norm_1"), _chars("address_norm_2")), "digit_jaccard": _j("numeric_tokens", "0.0"),
    "postal_same": _eq("postal_candidate"), "postal_conflict": _ne("postal_candidate"), "house_same": _eq("house_number"), "house_conflict": _ne("house_number"),
    "address_both_given": "CAST(address_norm_1 <> '' AND address_norm_2 <> '' AS INT)",
}


@query("fea12_address_8", _sql(_DETAIL))
def address_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows, features.address_detail_features()))


@query("fea14_block_13", "SELECT s1_id, target_id, CAST(list_contains(blocks, 'b1') AS INT)::DOUBLE AS exact_name, 0.0::DOUBLE AS rare_name, CAST(block_count AS DOUBLE) AS block_support, 999.0::DOUBLE AS best_rank, round(rare_w, 6) AS best_score, CAST(list_contains(blocks, 'b10') AS INT)::DOUBLE AS numeric FROM ranked WHERE block_rank < 22")
def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {k: F.lit(None).cast("int") for k in features.EVIDENCE} | {"exact_name": F.array_contains("blocks", "b1").cast("int"), "numeric": F.array_contains("blocks", "b10").cast("int")}
    flags |= {"n": F.col("block_count"), "best_rank": F.lit(None).cast("int"), "best_score": F.col("rare_w"), "bscore": F.lit(None).cast("double")}
    names = ("s1_id", "target_id", "exact_name", "rare_name", "block_support", "best_rank", "best_score", "numeric")
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows.withColumns(flags), features.block_features()).select(*names))


_ENTITY = {
    "cand_rank": "rank() OVER (PARTITION BY s1_id ORDER BY prescore DESC)", "score_gap": "max(prescore) OVER (PARTITION BY s1_id) - prescore", "n_cands": "count(*) OVER (PARTITION BY s1_id)",
    "n_strong": "count(*) FILTER (WHERE strong) OVER (PARTITION BY s1_id)", "evidence_diversity": "len(list_distinct(flatten(list(blocks) OVER (PARTITION BY s1_id))))",
}
_ALL = {f"basic_{k}": v for k, v in _BASIC.items()} | {f"lexical_{k}": v for k, v in _LEXICAL.items()} | {f"address_{k}": v for k, v in _DETAIL.items()}
_ALL |= {k: "0.0" for k in ("e5_name_score", "e5_full_score", "e5_max", "e5_mean", "e5_gap", *features.EVIDENCE, "bscore")} | {"block_support": "block_count", "best_rank": "block_rank", "best_score": "prescore"} | _ENTITY


@query("fea16_all_63", _sql(_ALL, "(SELECT *, prescore >= 0.5 * max(prescore) OVER (PARTITION BY s1_id) AS strong FROM ranked WHERE block_rank < 22)", 4))
def all_63(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {k: F.lit(None).cast("double") for k in ("e5_name_score", "e5_full_score", "e5_max", "e5_mean", "e5_gap", "bscore")} | {k: F.lit(None).cast("int") for k in features.EVIDENCE}
    more |= {"n": F.col("block_count"), "best_rank": F.col("block_rank"), "best_score": F.col("prescore")}
    entity = {k: F.col(k) for k in ("cand_rank", "score_gap", "n_cands", "n_strong", "evidence_diversity")}
    made = {f"basic_{k}": v for k, v in features.basic_features().items()} | {f"lexical_{k}": v for k, v in features.lexical_features().items()}
    made |= {f"address_{k}": v for k, v in features.address_detail_features().items()} | features.e5_features() | features.block_features() | entity
    return ranked_pairs(spark, sf_dir, then=lambda rows: _plain(features.entity_features(rows, "prescore").withColumns(more), made, 4))


@query("fea21_miss_kinds", f"SELECT CASE WHEN n >= 0.5 AND a >= 0.5 THEN 'both' WHEN n >= 0.5 THEN 'name' WHEN a >= 0.5 THEN 'address' ELSE 'neither' END AS kind, count(*) AS n FROM (SELECT {_j('name_tokens')} AS n, {_j('address_tokens')} AS a FROM ranked WHERE block_rank < 22) GROUP BY 1")
def miss_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.name_features() | features.address_features()
    return metrics.miss_kinds(ranked_pairs(spark, sf_dir, then=lambda rows: _plain(rows, {k: made[k] for k in ("name_jaccard", "address_jaccard")}, 9)))


@query("fea22_translit_view", "SELECT entity_id, name_translit FROM norm")
def translit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.records(spark, sf_dir).select("entity_id", text.transliterate(text.normalize_name(F.col("business_name"))).alias("name_translit"))
