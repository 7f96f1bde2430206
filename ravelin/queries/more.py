"""Smaller operators that the larger queries contain, each by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.config import DEFAULTS
from ravelin.functions import text
from ravelin.functions.similarity import hashed_counts
from ravelin.operators import blocking, decisions, metrics, vectors
from ravelin.queries.base import both_sides, normalized, query, table, truth_lists
from ravelin.queries.blocking import candidate_lists
from ravelin.queries.decisions import _P, _gate, scored
from ravelin.queries.sources import folder
from ravelin.sources import roles, tables

_LISTS = "l AS (SELECT s1_id, list_sort(list(DISTINCT target_id)) AS c FROM plain_hits WHERE channel IN ('b3', 'b5') GROUP BY s1_id)"


@query("src10_heads", "SELECT source, count(*) AS n FROM (SELECT substr(entity_id, 1, 2) AS source, row_number() OVER (PARTITION BY substr(entity_id, 1, 2)) AS k FROM records) WHERE k <= 5 GROUP BY source")
def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped smoke read: five rows of each source."""
    rows = roles.records(spark, sf_dir)
    lanes = [rows.filter(F.col("entity_id").startswith(f"{s}-")) for s in ("S1", "S2", "S3")]
    return tables.head_of_each(lanes, 5).groupBy(tables.source_of(F.col("entity_id")).alias("source")).agg(F.count("*").alias("n"))


@query("src17_candidate_scan", f"WITH {_LISTS} SELECT s1_id, len(c) AS n, array_to_string(c, ',') AS candidates FROM l")
def candidate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{folder(spark)}/candidates"
    rows = candidate_lists(spark, sf_dir).select(F.col("s1_id").alias("source1_entity_id"), tables.listed(F.col("candidates")).alias("candidate_entity_ids"))
    tables.write_tsv(rows, place)
    return tables.read_candidates(spark, place).select("s1_id", F.size("candidates").cast("long").alias("n"), F.array_join("candidates", ",").alias("candidates"))


@query("snk3_unfiltered_lists", "SELECT s1_id AS source1_entity_id, array_to_string(list_sort(list_concat(matched, [s1_id])), ',') AS matched_entity_ids FROM tl")
def unfiltered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = truth_lists(spark, sf_dir)
    return tables.output_lists(truth, truth.select("s1_id", F.concat("matched", F.array("s1_id")).alias("matched")), "matched", "matched_entity_ids", prefixes=())


@query("snk5_zstd_append", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def zstd_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, rows = f"{folder(spark)}/orders", table(spark, sf_dir, "orders")
    for part in (rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 <> 0")):
        part.write.mode("append").option("compression", "zstd").parquet(place)
    return spark.read.parquet(place).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("str8_compact", "SELECT doc_id, md5(replace(text, ' ', '')) AS digest FROM documents")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.compact(F.col("text"))).alias("digest"))


@query("str14_ascii_fold", "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def ascii_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_fold(F.col("text"))).alias("digest"))


@query("str19_token_set", "SELECT conv_id, turn, len(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> ''))) AS n FROM conversations")
def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.token_set(F.lower("text"))).cast("long").alias("n"))


@query("str24_plain_words", r"SELECT page_id, md5(trim(regexp_replace(lower(html), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM pages")
def plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(F.lower("html"), "[^a-z0-9]+", " "))).alias("digest"))


@query("flt4_common_grams", "WITH g AS (SELECT country, g, count(*) AS df FROM (SELECT DISTINCT entity_id, country_norm AS country, unnest(list_transform(range(1, length('#' || name_norm || '#') - 1), lambda i: substr('#' || name_norm || '#', i, 3))) AS g FROM tg WHERE name_norm <> '') GROUP BY 1, 2) SELECT g.country, g AS token, df FROM g JOIN (SELECT country_norm AS country, count(*) AS n FROM tg GROUP BY 1) s ON g.country = s.country WHERE df <= greatest(50, floor(n * 0.02))")
def common_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, targets = both_sides(spark, sf_dir)
    rows = targets.withColumn("grams", text.char_grams(F.col("name_norm")))
    sizes = targets.groupBy(F.col("country_norm").alias("country")).agg(F.count("*").alias("n"))
    found = blocking.document_frequency(rows, "grams", by_country=True).join(F.broadcast(sizes), "country")
    return found.filter(F.col("df") <= F.greatest(F.lit(50), F.floor(F.col("n") * 0.02))).select("country", "token", "df")


@query("flt10_id_prefix", f"WITH {_LISTS} SELECT s1_id, len(list_filter(c, lambda x: regexp_matches(x, '^S3-'))) AS n FROM l")
def id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = candidate_lists(spark, sf_dir)
    cell = tables.listed(F.col("candidates"), ("S3-",))
    return lists.select("s1_id", F.size(F.filter(F.split(cell, ","), lambda x: x != "")).cast("long").alias("n"))


@query("agg3_postings", "SELECT country, key, string_agg(id, ',' ORDER BY id) AS postings FROM keys WHERE channel = 'b5' GROUP BY country, key")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = blocking.capped(blocking.block_keys(normalized(spark, sf_dir), ("b5",)), 20_000)
    return keys.groupBy("country", "key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("postings"))


@query("agg9_count_quantiles", f"WITH {_LISTS} SELECT round(avg(len(c)), 6) AS avg_n, round(quantile_cont(len(c), 0.9), 6) AS p90, max(len(c)) AS max_n FROM l")
def count_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = candidate_lists(spark, sf_dir)
    return metrics.count_stats(lists, lists).select("avg_n", "p90", "max_n")


@query("agg11_budget", f"WITH {_LISTS}, s AS (SELECT round(avg(len(coalesce(c, []))), 6) AS avg_n FROM tl LEFT JOIN l ON tl.s1_id = l.s1_id) SELECT avg_n, avg_n <= 15 AS within FROM s")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.count_stats(truth_lists(spark, sf_dir), candidate_lists(spark, sf_dir)).persist()
    return stats.select("avg_n", F.lit(metrics.within_budget(stats, strict=False)).alias("within"))


@query("set3_entity_sets", f"WITH {_LISTS} SELECT t.s1_id, len(list_intersect(matched, coalesce(c, []))) AS n_both, len(list_filter(matched, lambda x: NOT list_contains(coalesce(c, []), x))) AS n_missed, len(list_distinct(list_concat(matched, coalesce(c, [])))) AS n_any FROM tl t LEFT JOIN l ON t.s1_id = l.s1_id")
def entity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce("candidates", F.array().cast("array<string>"))
    rows = truth_lists(spark, sf_dir).join(candidate_lists(spark, sf_dir), "s1_id", "left").withColumn("c", c)
    sizes = {"n_both": F.array_intersect("matched", "c"), "n_missed": F.array_except("matched", "c"), "n_any": F.array_union("matched", "c")}
    return rows.select("s1_id", *(F.size(v).cast("long").alias(k) for k, v in sizes.items()))


@query("win11_lane_ranks", f"WITH {_P} SELECT s1_id, target_id, lane_rank FROM (SELECT s1_id, target_id, row_number() OVER (PARTITION BY s1_id, substr(target_id, 1, 2) ORDER BY p DESC, target_id) - 1 AS lane_rank FROM p) WHERE lane_rank < 12")
def lane_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select(F.col("s1_id").alias("query_id"), "target_id", F.col("p").alias("score"))
    return vectors.per_source(rows, 12).select(F.col("query_id").alias("s1_id"), "target_id", F.col("ann_rank").cast("long").alias("lane_rank"))


@query("mdl6_fine_sweep", f"WITH {_P} SELECT threshold, count(p.target_id) AS n_pairs, CAST(coalesce(sum(p.label), 0) AS BIGINT) AS n_true FROM (SELECT unnest([0.41, 0.42, 0.43, 0.44, 0.45, 0.46, 0.47, 0.48, 0.49])::DOUBLE AS threshold) LEFT JOIN p ON p.p >= threshold GROUP BY threshold")
def fine_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What steps of a hundredth around a threshold accept, counted in one pass."""
    steps = [round(0.45 + k / 100, 2) for k in range(-4, 5)]
    counts = scored(spark, sf_dir).agg(*(F.struct(F.lit(s).alias("threshold"), F.count_if(F.col("p") >= s).alias("n_pairs"), F.count_if((F.col("p") >= s) & (F.col("label") == 1)).alias("n_true")).alias(f"s{k}") for k, s in enumerate(steps)))
    return counts.select(F.explode(F.array(*(f"s{k}" for k in range(len(steps))))).alias("x")).select("x.*")


_SINGLETON = " UNION ALL ".join(
    f"SELECT {s}::DOUBLE AS singleton, (SELECT count(*) FROM (WITH {_gate(0.45, s)} SELECT * FROM g)) AS n_pairs, (SELECT count(DISTINCT s1_id) FROM (WITH {_gate(0.45, s)} SELECT * FROM g)) AS n_entities" for s in DEFAULTS.decision.singleton_grid
)


@query("mdl8_singleton_sweep", f"WITH {_P} {_SINGLETON}")
def singleton_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs and entities each singleton threshold lets through, over one materialised table of scored pairs."""
    rows = scored(spark, sf_dir).persist()
    out = None
    for s in DEFAULTS.decision.singleton_grid:
        part = decisions.gate(rows, 0.45, s).agg(F.count("*").alias("n_pairs"), F.countDistinct("s1_id").alias("n_entities")).select(F.lit(s).alias("singleton"), "n_pairs", "n_entities")
        out = part if out is None else out.unionByName(part)
    return out


@query("jn_e5_two_views")
def two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by the name alone and by name and address, the best of both."""
    s1, targets = both_sides(spark, sf_dir)
    out = None
    for tokens in (F.col("name_tokens"), F.concat("name_tokens", "address_tokens")):
        sides = [r.select(F.col("entity_id").alias("id"), hashed_counts(tokens).alias("vector"), F.col("country_norm").alias("country")) for r in (s1, targets)]
        found = vectors.exact_neighbours(*sides, 12, same="country")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("query_id", "target_id").agg(F.round(F.max("score"), 6).alias("score"), F.min("ann_rank").cast("long").alias("ann_rank"))
