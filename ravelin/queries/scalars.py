"""Text, number and pattern functions over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import numbers, similarity, tables, text
from ravelin.operators import normalize
from ravelin.queries.base import normalized, query, sql_address, sql_basic, sql_canon, sql_fold, sql_jaccard, sql_map, sql_strip, sql_tokens, table
from ravelin.sources import roles


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("str1_unicode_norm", "SELECT doc_id, md5(nfc_normalize(text)) AS digest, length(nfc_normalize(text)) AS n FROM documents")
def unicode_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = docs(spark, sf_dir).withColumn("t", text.unicode_norm(F.col("text")))
    return made.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("str2_lower_ws", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def lower_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(text.lower_ws(F.col("text"))).alias("digest"))


@query("str3_fold_punct", f"SELECT doc_id, md5({sql_fold('text')}) AS digest FROM documents")
def fold_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(text.fold_punct(F.col("text"))).alias("digest"))


@query("str4_country", f"SELECT entity_id, {sql_map(sql_basic('country'), tables.COUNTRY_ALIASES)} AS country FROM records")
def country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.records(spark, sf_dir).select("entity_id", text.normalize_country(F.col("country")).alias("country"))


@query("str5_normalize_name", f"SELECT doc_id, md5({sql_basic('nfc_normalize(text)')}) AS digest FROM documents")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(text.normalize_name(F.col("text"))).alias("digest"))


@query("str6_normalize_address", f"SELECT doc_id, md5({sql_address('nfc_normalize(text)')}) AS digest FROM documents")
def normalize_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(text.normalize_address(F.col("text"))).alias("digest"))


@query("str7_name_core", "SELECT entity_id, name_core, name_compact FROM norm")
def name_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select("entity_id", "name_core", "name_compact")


@query("str9_tokens", f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {sql_tokens(sql_basic('nfc_normalize(text)'))} AS t FROM documents)")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = docs(spark, sf_dir).withColumn("t", text.tokens(text.basic(F.col("text"))))
    return made.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(
    "str10_normalized_record",
    "SELECT entity_id, country_norm, name_norm, name_translit, name_core, name_compact, address_norm, address_compact, house_number, array_to_string(numeric_tokens, ',') AS numeric_tokens, numeric_signature, postal_candidate, CAST(address_missing AS BIGINT) AS address_missing FROM norm",
)
def normalized_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select(
        "entity_id", "country_norm", "name_norm", "name_translit", "name_core", "name_compact", "address_norm", "address_compact", "house_number",
        F.array_join("numeric_tokens", ",").alias("numeric_tokens"), "numeric_signature", "postal_candidate", F.col("address_missing").cast("long").alias("address_missing"),
    )


@query("str11_transliterate", r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS digest FROM documents")
def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(text.transliterate(F.col("text"))).alias("digest"))


@query("str12_transliterate_wide", r"SELECT doc_id, md5(trim(regexp_replace(strip_accents(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def transliterate_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(text.transliterate_wide(F.col("text"))).alias("digest"))


@query("str13_has_non_latin", r"SELECT doc_id, regexp_matches(text, '[^\x00-\x7F]') AS non_latin FROM documents")
def has_non_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.has_non_latin(F.col("text")).alias("non_latin"))


@query("str15_basic_clean", f"SELECT doc_id, md5({sql_basic('strip_accents(text)')}) AS digest FROM documents")
def basic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(text.basic_clean(F.col("text"))).alias("digest"))


@query("str16_expand_tokens", f"SELECT entity_id, array_to_string(list_transform({sql_tokens('name_norm')}, lambda w: {sql_map('w', tables.NAME_EXPANSIONS)}), ' ') AS name, array_to_string(list_transform({sql_tokens(sql_basic('address_raw'))}, lambda w: {sql_map('w', tables.ADDRESS_EXPANSIONS)}), ' ') AS address FROM norm")
def expand_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.records(spark, sf_dir)
    return rows.select("entity_id", text.full_name(F.col("business_name")).alias("name"), text.full_address(F.col("business_address")).alias("address"))


_FULL = f"(SELECT entity_id, array_to_string(list_transform({sql_tokens('name_norm')}, lambda w: {sql_map('w', tables.NAME_EXPANSIONS)}), ' ') AS n FROM norm)"
_LEGAL = ", ".join(f"'{w}'" for w in tables.FULL_LEGAL_SUFFIXES)


@query("str18_core_names", f"SELECT entity_id, array_to_string(list_filter({sql_tokens('n')}, lambda w: w NOT IN ({_LEGAL})), ' ') AS core, {sql_strip('n', tables.FULL_LEGAL_SUFFIXES)} AS compact FROM {_FULL}")
def core_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.full_name(F.col("business_name"))
    rows = roles.records(spark, sf_dir).select("entity_id", n.alias("n"))
    return rows.select("entity_id", text.full_core(F.col("n")).alias("core"), text.full_core_compact(F.col("n")).alias("compact"))


@query("str20_views", "SELECT entity_id, trim(name_norm || ' ' || address_norm) AS combined, trim('name: ' || name_norm || CASE WHEN address_norm <> '' THEN ' address: ' || address_norm ELSE '' END) AS full_view FROM norm")
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized(spark, sf_dir)
    return rows.select("entity_id", text.combined_text(F.col("name_norm"), F.col("address_norm")).alias("combined"), text.view(name=F.col("name_norm"), address=F.col("address_norm")).alias("full_view"))


@query("str21_semantic_text", "SELECT entity_id, left(array_to_string(list_filter([name_norm, address_norm, country_norm, postal_candidate], lambda w: w <> ''), ' [SEP] '), 2000) AS t FROM norm")
def semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized(spark, sf_dir)
    return rows.select("entity_id", text.semantic_text(*(F.col(c) for c in ("name_norm", "address_norm", "country_norm", "postal_candidate"))).alias("t"))


@query("str22_full_record", "SELECT entity_id, country_norm, house_number IS NOT NULL AS has_record, postal_candidate FROM norm")
def full_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.full(roles.records(spark, sf_dir))
    return rows.select("entity_id", "country_norm", F.col("combined_text").isNotNull().alias("has_record"), F.coalesce(F.array_min("postal_candidates"), F.lit("")).alias("postal_candidate"))


@query(
    "str25_char_grams",
    "SELECT gram, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM (SELECT doc_id, '#' || lower(text) || '#' AS t FROM documents WHERE text <> '')) GROUP BY gram",
)
def char_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.explode(text.char_grams(F.lower("text"))).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("df"))


@query("num1_canon_house", f"SELECT entity_id, {sql_canon('address_raw')} AS canon FROM norm")
def canon_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.records(spark, sf_dir).select("entity_id", numbers.canon_house(F.col("business_address")).alias("canon"))


_RUNS = r"regexp_extract_all(text, '(\d+)', 1)"


@query("num2_numbers", f"SELECT doc_id, len(r) AS n, md5(array_to_string(list_sort(r), '|')) AS signature, coalesce(list_min(list_filter(r, lambda w: length(w) IN (5, 6))), '') AS postal FROM (SELECT doc_id, {_RUNS} AS r FROM documents)")
def all_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = docs(spark, sf_dir).withColumn("r", numbers.numeric_tokens(F.col("text")))
    return made.select("doc_id", F.size("r").cast("long").alias("n"), F.md5(numbers.signature(F.col("r"))).alias("signature"), numbers.postal_candidate(F.col("text")).alias("postal"))


@query("num4_postal_candidates", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({_RUNS}, lambda w: length(w) IN (5, 6)))), ',') AS postal FROM documents")
def postal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(numbers.postal_candidates(F.col("text")), ",").alias("postal"))


@query("num5_house_numbers", r"SELECT entity_id, array_to_string(list_filter(list_transform(regexp_extract_all(' ' || regexp_replace(address_raw, '([, .])', '\1\1', 'g') || ' ', '[ ,.]([0-9]{1,6}[a-zA-Z]?(?:[/-][0-9]{1,6}[a-zA-Z]?)?)[ ,.]', 1), lambda w: w), lambda w: w <> '')[1:8], ',') AS houses FROM norm")
def house_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.records(spark, sf_dir).select("entity_id", F.array_join(numbers.house_numbers(F.col("business_address")), ",").alias("houses"))


@query("num6_pin_boosters", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(\d{5,6})', 1))), ',') AS pins FROM documents")
def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(numbers.pin_boosters(F.col("text"))), ",").alias("pins"))


@query(
    "num7_pattern_flags",
    f"SELECT count(*) FILTER (WHERE len(list_filter(r, lambda w: length(w) = 4)) > 0) AS has_4, count(*) FILTER (WHERE len(list_filter(r, lambda w: length(w) = 5)) > 0) AS has_5, count(*) FILTER (WHERE len(list_filter(r, lambda w: length(w) = 6)) > 0) AS has_6, "
    r"count(*) FILTER (WHERE regexp_matches(text, '\+?\d[\d ()-]{8,}\d')) AS has_phone, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS has_email, count(*) FILTER (WHERE regexp_matches(text, 'https?://')) AS has_url, "
    rf"count(*) FILTER (WHERE regexp_matches(text, '(?i)(no|house|plot|flat)[. ]*\d')) AS has_house FROM (SELECT text, {_RUNS} AS r FROM documents)",
)
def pattern_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.operators import profile

    return profile.patterns(docs(spark, sf_dir), "text")


@query("fea1_jaccard", f"SELECT a.item_id AS a, b.item_id AS b, round({sql_jaccard('a.t', 'b.t')}, 6) AS jaccard FROM (SELECT item_id, {sql_tokens(sql_basic('text'))} AS t FROM benchmark) a JOIN (SELECT item_id, {sql_tokens(sql_basic('text'))} AS t FROM benchmark) b ON a.item_id < b.item_id")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(text.basic(F.col("text"))).alias("t"))
    left, right = rows.select(F.col("item_id").alias("a"), F.col("t").alias("x")), rows.select(F.col("item_id").alias("b"), F.col("t").alias("y"))
    return left.join(F.broadcast(right), F.col("a") < F.col("b")).select("a", "b", F.round(similarity.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(
    "fea19_cosine",
    "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id + 1 = b.vec_id",
)
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    left = rows.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x"))
    right = rows.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("y"))
    return left.join(right.withColumn("a", F.col("b") - 1), ["a", "label"]).select("a", "b", F.round(similarity.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query(
    "fea20_hashed_counts",
    "SELECT entity_id, ('0x' || substr(md5(w), 31, 2))::INT AS place, count(*)::DOUBLE AS value FROM (SELECT entity_id, unnest(name_tokens) AS w FROM norm) GROUP BY 1, 2",
)
def hashed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized(spark, sf_dir).select("entity_id", similarity.hashed_counts(F.col("name_tokens")).alias("v"))
    return rows.select("entity_id", F.posexplode("v").alias("place", "value")).filter("value > 0")
