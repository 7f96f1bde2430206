"""Scans, sinks, caches and joins by id."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import normalize
from ravelin.queries.base import both_sides, normalized, query, table, truth_lists
from ravelin.sources import roles, tables


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/') if shared else tempfile.mkdtemp(prefix='ravelin-tables-')}/tables-{uuid.uuid4().hex}"


@query("src1_record_scan", "SELECT entity_id, trim(business_name) AS business_name, trim(business_address) AS business_address, country FROM records")
def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{folder(spark)}/records"
    tables.write_tsv(roles.records(spark, sf_dir), place)
    rows = tables.read_records(spark, place)
    return rows.select("entity_id", F.trim("business_name").alias("business_name"), F.trim("business_address").alias("business_address"), "country")


@query("src2_column_scan", "SELECT entity_id, country FROM records")
def column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{folder(spark)}/records"
    tables.write_tsv(roles.records(spark, sf_dir), place)
    return tables.read_records(spark, place, ("entity_id", "country"), keep_blank_ids=True)


@query("src3_truth_scan", "SELECT s1_id, array_to_string(matched, ',') AS matched, len(matched) AS n FROM tl")
def truth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{folder(spark)}/truth"
    cells = truth_lists(spark, sf_dir).select(F.col("s1_id").alias("source1_entity_id"), F.array_join("matched", " , ").alias("matched_entity_ids"))
    tables.write_tsv(cells, place)
    return tables.read_truth(spark, place).select("s1_id", F.array_join("matched", ",").alias("matched"), F.size("matched").cast("long").alias("n"))


@query("src4_ordered_ids", "SELECT entity_id AS s1_id FROM records WHERE entity_id LIKE 'S1-%'")
def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, _ = roles.split(roles.records(spark, sf_dir))
    return tables.ordered_ids(s1).orderBy("ord").select("s1_id")


@query("src5_row_counts", "SELECT substr(entity_id, 1, 2) AS source, count(*) AS n FROM records GROUP BY 1")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.records(spark, sf_dir).groupBy(tables.source_of(F.col("entity_id")).alias("source")).agg(F.count("*").alias("n"))


@query(
    "src6_wide_blank_truth",
    "SELECT s1_id, CASE WHEN len(matched) = 0 THEN 0 ELSE len(matched) END AS n FROM tl",
)
def wide_blank_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = truth_lists(spark, sf_dir).select(F.col("s1_id").alias("source1_entity_id"), F.when(F.size("matched") == 0, F.when(F.col("s1_id") < "S1-000000500", "NaN").otherwise("none")).otherwise(F.array_join("matched", ",")).alias("matched_entity_ids"))
    return tables.truth_lists(cells, wide_blanks=True).select("s1_id", F.size("matched").cast("long").alias("n"))


@query("src7_normalized_cache", "SELECT entity_id, country_norm, name_norm, name_core, name_compact, address_norm, house_number, array_to_string(numeric_tokens, ' ') AS numeric_tokens, numeric_signature, postal_candidate, CAST(address_missing AS BIGINT) AS address_missing FROM norm")
def normalized_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.ensure_cache(spark, f"{folder(spark)}/cache", lambda: normalize.lean(normalized(spark, sf_dir)))
    return rows.select("entity_id", "country_norm", "name_norm", "name_core", "name_compact", "address_norm", "house_number", F.array_join("numeric_tokens", " ").alias("numeric_tokens"), "numeric_signature", "postal_candidate", F.col("address_missing").cast("long").alias("address_missing"))


@query("src8_projected_parquet", "SELECT l_returnflag, count(*) AS n, sum(CAST(l_linenumber AS BIGINT))::BIGINT AS lines FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def projected_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select("l_returnflag", "l_linenumber")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))


@query("src12_truth_side_join", "SELECT r.entity_id, len(t.matched) AS n FROM records r JOIN tl t ON r.entity_id = t.s1_id WHERE len(t.matched) > 0")
def truth_side_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = truth_lists(spark, sf_dir)
    wanted = truth.filter(F.size("matched") > 0).select("s1_id")
    s1 = tables.only(roles.records(spark, sf_dir), wanted)
    return s1.join(truth.withColumnRenamed("s1_id", "entity_id"), "entity_id", "left").select("entity_id", F.size("matched").cast("long").alias("n"))


@query("src14_fetch_targets", "SELECT entity_id, business_name FROM records WHERE entity_id IN (SELECT target_id FROM truth)")
def fetch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.records(spark, sf_dir)
    lanes = [rows.filter(F.col("entity_id").startswith(f"{s}-")) for s in ("S2", "S3")]
    return tables.fetch_targets(lanes, roles.truth(spark, sf_dir).select("target_id")).select("entity_id", "business_name")


@query("src15_truth_of_ids", "SELECT s1_id, len(matched) AS n FROM tl")
def truth_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, _ = roles.split(roles.records(spark, sf_dir))
    some = truth_lists(spark, sf_dir).filter(F.size("matched") > 0)
    return tables.truth_for(s1.select(F.col("entity_id").alias("s1_id")), some).select("s1_id", F.size("matched").cast("long").alias("n"))


@query(
    "src18_artifact_checks",
    "SELECT '' AS missing, count(*) AS n_rows, round(avg(CAST(s1_id LIKE 'S1-%' AS DOUBLE)), 6) AS prefix_share, CAST(sum(CAST(trim(s1_id) = '' AS INT)) AS BIGINT) AS n_blank, count(*) - count(DISTINCT s1_id || target_id) AS n_repeated FROM truth",
)
def artifact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.artifact_checks(roles.truth(spark, sf_dir), ("s1_id", "target_id"))


@query("snk1_matching_output", "SELECT s1_id AS source1_entity_id, array_to_string(matched, ',') AS matched_entity_ids FROM tl")
def matching_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = truth_lists(spark, sf_dir)
    doubled = truth.withColumn("matched", F.concat(F.reverse("matched"), F.array(F.lit("S1-x")), "matched")).filter(F.size("matched") > 1)
    return tables.matching_output(truth, doubled)


@query("snk2_candidate_output", "SELECT s.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT h.target_id, ',' ORDER BY h.target_id), '') AS candidate_entity_ids FROM s1 s LEFT JOIN (SELECT * FROM plain_hits WHERE channel = 'b12') h ON s.entity_id = h.s1_id GROUP BY s.entity_id")
def candidate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.operators import blocking

    s1, targets = both_sides(spark, sf_dir)
    found = blocking.candidates(s1, targets, ("b12",)).groupBy("s1_id").agg(F.collect_list("target_id").alias("candidates"))
    return tables.candidate_output(s1.select(F.col("entity_id").alias("s1_id")), found)


@query("snk4_resume", "SELECT s1_id FROM tl WHERE len(matched) = 0")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = truth_lists(spark, sf_dir)
    return tables.without_done(truth, truth.filter(F.size("matched") > 0)).select("s1_id")


@query("snk8_vector_shards", "SELECT vec_id AS id, label, round(list_sum(embedding), 4) AS total FROM embeddings")
def vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{folder(spark)}/vectors"
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    tables.write_vectors(rows, place)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(place).select("id", "label", F.round(total, 4).alias("total"))


@query(
    "snk11_merge_candidates",
    "WITH b AS (SELECT s1_id, list_sort(list(target_id)) AS l FROM (SELECT DISTINCT s1_id, target_id FROM plain_hits WHERE channel = 'b12') GROUP BY s1_id), e AS (SELECT s1_id, list_sort(list(target_id)) AS l FROM (SELECT DISTINCT s1_id, target_id FROM plain_hits WHERE channel = 'b5') GROUP BY s1_id), "
    "u AS (SELECT coalesce(b.s1_id, e.s1_id) AS s1_id, coalesce(b.l, []) AS bl, coalesce(e.l, []) AS el FROM b FULL JOIN e ON b.s1_id = e.s1_id) "
    "SELECT s1_id, array_to_string((list_concat(bl, list_filter(el, lambda x: NOT list_contains(bl, x))))[1:15], ',') AS candidates FROM u",
)
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.operators import blocking

    s1, targets = both_sides(spark, sf_dir)
    lists = [blocking.candidates(s1, targets, (c,)).groupBy("s1_id").agg(F.array_sort(F.collect_set("target_id")).alias("candidates")) for c in ("b12", "b5")]
    return tables.merge_candidates(lists[0], lists[1]).select("s1_id", F.array_join("candidates", ",").alias("candidates"))
