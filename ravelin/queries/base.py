"""The registry, and the SQL of what the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import tables
from ravelin.operators import normalize
from ravelin.sources import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; sql may use the shared tables of `with_tables`."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_tables(sql)
        return f

    return keep


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.spec(roles.records(spark, sf_dir))


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return roles.split(normalized(spark, sf_dir))


def truth_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, matched) for every S1 record."""
    s1, _ = roles.split(roles.records(spark, sf_dir))
    pairs = roles.truth(spark, sf_dir).groupBy("s1_id").agg(F.array_sort(F.collect_set("target_id")).alias("m"))
    return s1.select(F.col("entity_id").alias("s1_id")).join(pairs, "s1_id", "left").select("s1_id", F.coalesce("m", F.array().cast("array<string>")).alias("matched"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces ----------------------------------------------------------------------------------------------------------


def sql_fold(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace({x}, '&', ' and '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[_\s]+', ' ', 'g'))"


def sql_basic(x: str) -> str:
    return f"lower({sql_fold(x)})"


def sql_map(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {x} END"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def sql_strip(x: str, words: tuple[str, ...], most: int = 3) -> str:
    return f"regexp_replace({x}, '(?:(?:^| )(?:{'|'.join(words)})){{1,{most}}}$', '')"


def sql_canon(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '[\s\-/]+', '', 'g'), '^0+([0-9])', '\1')"


HOUSE = r"(?i)\b(?:h\.?\s*no\.?|house\s*no\.?|no\.?|#|plot|shop|unit|flat|apt\.?)?\s*(\d{1,6}[A-Za-z]?(?:\s*[/\-]\s*\d{1,6}[A-Za-z]?)?)"
_ADDRESS = tables.ADDRESS_WORDS | {w: "house" for w in tables.HOUSE_WORDS}


def sql_address(x: str) -> str:
    return f"array_to_string(list_transform({sql_tokens(sql_basic(x))}, lambda w: {sql_map('w', _ADDRESS)}), ' ')"


def sql_house(x: str) -> str:
    return sql_canon(f"regexp_extract({x}, '{HOUSE}', 1)")


def sql_jaccard(a: str, b: str, empty: str = "1.0") -> str:
    return (
        f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty} ELSE "
        f"len(list_intersect(list_distinct({a}), list_distinct({b}))) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END"
    )


def _norm() -> str:
    return f"""
records AS MATERIALIZED ({roles.RECORDS_SQL}),
norm0 AS (SELECT entity_id, business_name AS name_raw, business_address AS address_raw, {sql_map(sql_basic('country'), tables.COUNTRY_ALIASES)} AS country_norm,
  {sql_basic('business_name')} AS name_norm, {sql_address('business_address')} AS address_norm,
  {sql_house("concat(business_name, ' ', business_address)")} AS house_number,
  regexp_extract_all(concat(business_name, ' ', business_address), '(\\d+)', 1) AS numeric_tokens,
  CAST(trim(business_address) = '' AS INT) AS address_missing FROM records),
norm AS MATERIALIZED (SELECT *, name_norm AS name_translit, {sql_strip('name_norm', tables.LEGAL_SUFFIXES)} AS name_core, replace(name_norm, ' ', '') AS name_compact,
  {sql_tokens('name_norm')} AS name_tokens, address_norm AS address_translit, replace(address_norm, ' ', '') AS address_compact,
  {sql_tokens('address_norm')} AS address_tokens, array_to_string(list_sort(numeric_tokens), '|') AS numeric_signature,
  coalesce(list_min(list_filter(numeric_tokens, lambda w: length(w) IN (5, 6))), '') AS postal_candidate FROM norm0),
s1 AS (SELECT * FROM norm WHERE entity_id LIKE 'S1-%'),
tg AS (SELECT * FROM norm WHERE entity_id NOT LIKE 'S1-%')"""


def _keys() -> str:
    c = "chr(1)"
    single = {
        "b1": ("name_norm", "name_norm <> ''"),
        "b2": ("name_translit", "name_translit <> ''"),
        "b3": ("name_core", "name_core <> ''"),
        "b4": ("name_compact", "name_compact <> ''"),
        "b12": (f"name_norm || {c} || address_norm", "name_norm <> '' AND address_norm <> ''"),
        "b5": (f"name_core || {c} || house_number", "name_core <> '' AND house_number <> ''"),
        "b10": ("numeric_signature", "numeric_signature <> ''"),
        "b11": (f"postal_candidate || {c} || house_number", "postal_candidate <> '' AND house_number <> ''"),
    }
    parts = [f"SELECT entity_id AS id, country_norm AS country, '{k}' AS channel, {key} AS key FROM norm WHERE {where}" for k, (key, where) in single.items()]
    for k, other in (("b6", "postal_candidate"), ("b7", "house_number")):
        parts.append(f"SELECT DISTINCT id, country, '{k}', tok || {c} || other FROM (SELECT entity_id AS id, country_norm AS country, unnest(name_tokens[1:8]) AS tok, {other} AS other FROM norm WHERE {other} <> '')")
    return f"keys AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def _rare(df_cap: int = 300, most: int = 12) -> str:
    out = []
    for ch, col in (("b8", "name_tokens"), ("b9", "address_tokens")):
        out.append(f"""
{ch}_df AS (SELECT tok, count(*) AS df FROM (SELECT DISTINCT entity_id, unnest({col}) AS tok FROM tg) GROUP BY tok),
{ch}_q AS (SELECT id, country, house_number, tok, df FROM (SELECT id, country, house_number, q.tok, df, row_number() OVER (PARTITION BY id ORDER BY coalesce(df, 0), q.tok) AS place
  FROM (SELECT DISTINCT entity_id AS id, country_norm AS country, house_number, unnest({col}) AS tok FROM s1) q LEFT JOIN {ch}_df d ON q.tok = d.tok) WHERE place <= {most} AND df <= {df_cap}),
{ch}_t AS (SELECT DISTINCT entity_id AS id, country_norm AS country, house_number, tok FROM (SELECT entity_id, country_norm, house_number, unnest({col}) AS tok FROM tg) x
  WHERE tok IN (SELECT tok FROM {ch}_df WHERE df <= {df_cap}))""")
    out.append("""
rare_hits AS (SELECT q.id AS s1_id, t.id AS target_id, 'b8' AS channel, ln((SELECT count(*) FROM tg) / CAST(1 + q.df AS DOUBLE)) AS w FROM b8_q q JOIN b8_t t ON q.country = t.country AND q.tok = t.tok
  UNION ALL SELECT q.id, t.id, 'b9', 0.0 FROM b9_q q JOIN b9_t t ON q.country = t.country AND q.tok = t.tok AND q.house_number = t.house_number)""")
    return ",".join(out)


PLAIN_HITS = "plain_hits AS MATERIALIZED (SELECT a.id AS s1_id, b.id AS target_id, a.channel FROM keys a JOIN keys b ON a.country = b.country AND a.channel = b.channel AND a.key = b.key WHERE a.id LIKE 'S1-%' AND b.id NOT LIKE 'S1-%')"
CAND = """cand AS MATERIALIZED (SELECT s1_id, target_id, list_sort(list_distinct(list(channel))) AS blocks, count(DISTINCT channel) AS block_count, sum(w) AS rare_w FROM
  (SELECT s1_id, target_id, channel, 0.0 AS w FROM plain_hits UNION ALL SELECT * FROM rare_hits) GROUP BY s1_id, target_id)"""
TRUTH = f"""truth AS MATERIALIZED ({roles.TRUTH_SQL}),
tl AS MATERIALIZED (SELECT s.entity_id AS s1_id, coalesce(list_sort(list(t.target_id) FILTER (WHERE t.target_id IS NOT NULL)), []) AS matched FROM records s LEFT JOIN truth t ON s.entity_id = t.s1_id WHERE s.entity_id LIKE 'S1-%' GROUP BY s.entity_id)"""


def _sides() -> str:
    columns = ("name_norm", "name_translit", "name_core", "name_compact", "name_tokens", "address_norm", "address_translit", "address_tokens", "house_number", "numeric_tokens", "numeric_signature", "postal_candidate", "address_missing", "country_norm")
    both = ", ".join(f"a.{c} AS {c}_1, b.{c} AS {c}_2" for c in columns)
    eq = lambda c: f"CAST({c}_1 <> '' AND {c}_1 = {c}_2 AS INT)"
    score = (
        f"5.0 * {eq('name_norm')} + 3.0 * {eq('name_core')} + 2.5 * {eq('name_translit')} + 2.0 * {eq('house_number')} + 1.5 * ({sql_jaccard('numeric_tokens_1', 'numeric_tokens_2', '0.0')})"
        f" + least(rare_w / 5.0, 2.0) + ({sql_jaccard('address_tokens_1', 'address_tokens_2')}) + 0.3 * block_count"
    )
    return f"""pairs AS MATERIALIZED (SELECT c.*, {both} FROM cand c JOIN s1 a ON c.s1_id = a.entity_id JOIN tg b ON c.target_id = b.entity_id),
scored AS MATERIALIZED (SELECT *, round({score}, 9) AS prescore FROM pairs),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prescore DESC, target_id DESC) - 1 AS block_rank FROM scored)"""


#: Shared tables in the order in which they build on each other, with the name by which a query asks for them.
_TABLES = (("norm", _norm), ("keys", _keys), ("plain_hits", lambda: PLAIN_HITS), ("rare_hits", _rare), ("cand", lambda: CAND), ("tl", lambda: TRUTH), ("ranked", _sides))
_NEEDS = {"keys": ("norm",), "plain_hits": ("norm", "keys"), "rare_hits": ("norm",), "cand": ("norm", "keys", "plain_hits", "rare_hits"), "tl": ("norm",), "ranked": ("norm", "keys", "plain_hits", "rare_hits", "cand")}
_ASKED = {"records": "norm", "norm": "norm", "s1": "norm", "tg": "norm", "keys": "keys", "plain_hits": "plain_hits", "rare_hits": "rare_hits", "cand": "cand", "tl": "tl", "truth": "tl", "pairs": "ranked", "scored": "ranked", "ranked": "ranked", "b8_df": "rare_hits"}


def with_tables(sql: str) -> str:
    """The statement with the shared tables that it names put before its own."""
    import re

    names = set(re.findall(r"\b[a-z_0-9]+\b", sql))
    need: set[str] = set()
    for asked, group in _ASKED.items():
        if asked in names:
            need |= {group, *_NEEDS.get(group, ())}
    parts = [make() for name, make in _TABLES if name in need]
    sql = sql.strip()
    if not parts:
        return sql
    head = ",\n".join(p.strip() for p in parts)
    if sql.upper().startswith("WITH "):
        return f"WITH {head},\n{sql[5:]}"
    return f"WITH {head}\n{sql}"
