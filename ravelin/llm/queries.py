"""The operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import langid, lm, media, packing, pieces, pii, quality, secrets, simhash, substring
from ravelin.llm.common import RID, numbered, read_documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(read_documents(spark, sf_dir))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    groups = simhash.near_duplicate_groups(numbered(read_documents(spark, sf_dir)))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(numbered(read_documents(spark, sf_dir))).drop(RID)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_rows(read_documents(spark, sf_dir))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_documents(spark, sf_dir))


def op7_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_documents(spark, sf_dir))


def op8_language_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_rows(read_documents(spark, sf_dir))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passage_rows(read_documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(read_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def queries() -> dict:
    """Queries by name, in the order of the operators."""
    found = [f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


#: The quality rules for DuckDB: measures from split words and lines, windows by position, the beta prior by moments.
QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM g) WHERE k > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.rid = r.rid),
f AS (SELECT host, {', '.join(f"CAST({rule} AS INT) AS {name}" for name, rule in quality.RULES.items())} FROM m),
h AS (SELECT host, count(*) AS n, {', '.join(f"sum({k}) AS {k}" for k in quality.RULES)} FROM f GROUP BY host),
p AS (SELECT count(*) AS hosts, CAST(sum(n) AS DOUBLE) AS docs, {', '.join(f"sum({k}) / CAST(sum(n) AS DOUBLE) AS {k}_m, sum({k} * {k} / CAST(n AS DOUBLE)) AS {k}_s" for k in quality.RULES)} FROM h),
b AS (SELECT *, {', '.join(f"({k}_s - docs * {k}_m * {k}_m - (hosts - 1) * {k}_m * (1 - {k}_m)) / docs AS {k}_v" for k in quality.RULES)} FROM p),
q AS (SELECT *, {', '.join(f"CASE WHEN {k}_v > 0 THEN least(greatest({k}_m * (1 - {k}_m) / {k}_v - 1, {quality.PRIOR_WEIGHTS[0]}), {quality.PRIOR_WEIGHTS[1]}) ELSE {quality.PRIOR_WEIGHTS[1]} END AS {k}_w" for k in quality.RULES)} FROM b),
z AS (SELECT *, {', '.join(f"least(greatest({k}_m + {quality.HOST_TAIL} * sqrt({k}_m * (1 - {k}_m) / ({k}_w + 1)), {quality.HOST_LIMITS[0]}), {quality.HOST_LIMITS[1]}) AS {k}_l" for k in quality.RULES)} FROM q),
v AS (SELECT host, greatest({', '.join(f"({k} + {k}_m * {k}_w) / (n + {k}_w)" for k in quality.RULES)}) AS host_rate, {' OR '.join(f"({k} + {k}_m * {k}_w) / (n + {k}_w) > {k}_l" for k in quality.RULES)} AS host_failed FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT host_failed AS kept, m.host, round(host_rate, 6) AS host_rate, host_failed
FROM m JOIN v ON m.host = v.host
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the method: the other operators need hashes, models, codes or search that it lacks."""
    return {"op7_quality_hosts": QUALITY_SQL}
