"""Readers and writers: tab-separated record tables, ground truth, candidate lists, normalized Parquet caches."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in RECORD_COLUMNS])
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_COLUMNS = ("source1_entity_id", "candidate_entity_ids")


class SchemaError(ValueError):
    """A file's header lacks a column, or is separated by something else than tabs."""


def _header(spark: SparkSession, path: str, wanted: tuple[str, ...]) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    names = [n.strip() for n in (first[0][0] if first else "").lstrip("﻿").split("\t")]
    missing = [n for n in wanted if n not in names]
    if missing:
        hint = "; is it separated by commas?" if len(names) == 1 and "," in names[0] else ""
        raise SchemaError(f"{path} lacks {', '.join(missing)}{hint}")
    return names


def _tsv(spark: SparkSession, path: str, wanted: tuple[str, ...]) -> DataFrame:
    names = _header(spark, path, wanted)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "\u0000").option("enforceSchema", True).csv(path)
    return rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in wanted))


def read_records(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD_COLUMNS, keep_blank_ids: bool = False) -> DataFrame:
    """A record table: all strings, missing values as "", rows with a blank id dropped unless they are to stay."""
    rows = _tsv(spark, path, RECORD_COLUMNS).select(*columns)
    if keep_blank_ids or "entity_id" not in columns:
        return rows
    return rows.withColumn("entity_id", F.trim("entity_id")).filter("entity_id <> ''")


def id_list(c: Column, blanks: tuple[str, ...] = ()) -> Column:
    """A comma-separated cell as distinct trimmed ids in their order; words in blanks count as empty cells."""
    cell = F.trim(F.coalesce(c, F.lit("")))
    if blanks:
        cell = F.when(F.lower(cell).isin(*blanks), "").otherwise(cell)
    return F.array_distinct(F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: x != ""))


def read_truth(spark: SparkSession, path: str, wide_blanks: bool = False) -> DataFrame:
    """(s1_id, matched array<string>); singletons have an empty array. With wide_blanks `nan` and `none` are empty too."""
    return truth_lists(_tsv(spark, path, TRUTH_COLUMNS), wide_blanks)


def truth_lists(rows: DataFrame, wide_blanks: bool = False) -> DataFrame:
    return rows.select(F.trim("source1_entity_id").alias("s1_id"), id_list(F.col("matched_entity_ids"), ("nan", "none") if wide_blanks else ()).alias("matched"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, target_id), one row for each match."""
    return truth.select("s1_id", F.explode("matched").alias("target_id"))


def truth_for(ids: DataFrame, truth: DataFrame) -> DataFrame:
    """The truth of given s1_ids; ids without one get an empty array."""
    return ids.join(truth, "s1_id", "left").select("s1_id", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    rows = _tsv(spark, path, CANDIDATE_COLUMNS)
    return rows.select(F.trim("source1_entity_id").alias("s1_id"), id_list(F.col("candidate_entity_ids")).alias("candidates"))


def only(records: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    """The records with an id of the given ones, once each."""
    return records.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi").dropDuplicates([column]).select(*records.columns)


def fetch_targets(tables: list[DataFrame], ids: DataFrame) -> DataFrame:
    """The rows of several target tables that ids ask for, once each."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return only(both, ids)


def head_of_each(tables: list[DataFrame], most: int) -> DataFrame:
    """Up to `most` rows of each table, for smoke runs."""
    out = tables[0].limit(most)
    for t in tables[1:]:
        out = out.unionByName(t.limit(most))
    return out


def ordered_ids(records: DataFrame) -> DataFrame:
    """(s1_id, ord): the ids with their place in the table, so that output can keep its order."""
    return records.select(F.col("entity_id").alias("s1_id"), F.monotonically_increasing_id().alias("ord"))


def source_of(id_column: Column) -> Column:
    """S1, S2 or S3: what stands before the first hyphen."""
    return F.substring_index(id_column, "-", 1)


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").option("nullValue", "").option("escapeQuotes", False).csv(path)


def listed(ids: Column, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> Column:
    """An id array as a cell: distinct, S2 before S3 and by id, comma-joined; ids with other prefixes go."""
    wanted = ids if not prefixes else F.filter(ids, lambda x: x.rlike("^(" + "|".join(prefixes) + ")"))
    return F.array_join(F.array_sort(F.array_distinct(wanted)), ",")


def output_lists(s1: DataFrame, lists: DataFrame, column: str, name: str, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """One row for each s1_id of s1, with the cell of its list; ids without one get an empty cell."""
    cell = F.coalesce(listed(F.col(column), prefixes), F.lit(""))
    return s1.select("s1_id").join(lists.select("s1_id", column), "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), cell.alias(name))


def matching_output(s1: DataFrame, predictions: DataFrame) -> DataFrame:
    return output_lists(s1, predictions, "matched", "matched_entity_ids")


def candidate_output(s1: DataFrame, candidates: DataFrame) -> DataFrame:
    return output_lists(s1, candidates, "candidates", "candidate_entity_ids")


def without_done(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: the rows whose s1_id isn't in the output yet."""
    return rows.join(done.select("s1_id").distinct(), "s1_id", "left_anti")


def write_cache(records: DataFrame, path: str) -> None:
    """Normalized records as Parquet; Spark commits the folder as a whole."""
    records.write.mode("overwrite").option("compression", "zstd").parquet(path)


def ensure_cache(spark: SparkSession, path: str, make) -> DataFrame:
    """The cache at path, made by make() only where there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        write_cache(make(), path)
    return spark.read.parquet(path)


def merge_candidates(base: DataFrame, extra: DataFrame, most: int = 15) -> DataFrame:
    """(s1_id, candidates): base lists, then what an extra channel adds, up to `most` in that order."""
    either = base.withColumnRenamed("candidates", "b").join(extra.withColumnRenamed("candidates", "e"), "s1_id", "full")
    none = F.array().cast("array<string>")
    return either.select("s1_id", F.slice(F.array_distinct(F.concat(F.coalesce("b", none), F.coalesce("e", none))), 1, most).alias("candidates"))


def artifact_checks(rows: DataFrame, wanted: tuple[str, ...], id_column: str = "s1_id", prefix: str = "S1-") -> DataFrame:
    """One row: missing columns, rows, share of ids with the prefix, repeated rows, blank ids."""
    missing = ",".join(c for c in wanted if c not in rows.columns)
    keys = [c for c in wanted if c in rows.columns]
    total = rows.agg(F.count("*").alias("n_rows"), F.avg(F.col(id_column).startswith(prefix).cast("double")).alias("prefix_share"), F.sum((F.trim(id_column) == "").cast("long")).alias("n_blank"))
    repeated = rows.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_repeated"))
    return total.join(F.broadcast(repeated), F.lit(True)).select(F.lit(missing).alias("missing"), "n_rows", F.round("prefix_share", 6).alias("prefix_share"), F.coalesce("n_blank", F.lit(0)).alias("n_blank"), "n_repeated")


def write_manifest(path: str, files: list[str], **facts) -> dict:
    """A JSON manifest with the SHA-256 of each file, on the driver."""
    found = {name: hashlib.sha256(Path(name).read_bytes()).hexdigest() for name in files}
    manifest = facts | {"files": found}
    Path(path).write_text(json.dumps(manifest, indent=1, sort_keys=True))
    return manifest


def verify_manifest(path: str) -> list[str]:
    """The manifest's files that are missing or changed."""
    manifest = json.loads(Path(path).read_text())
    return [f for f, digest in manifest["files"].items() if not Path(f).is_file() or hashlib.sha256(Path(f).read_bytes()).hexdigest() != digest]


def write_vectors(vectors: DataFrame, path: str, shards: int = 8) -> None:
    """(id, vector) as Parquet by shard."""
    vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).write.mode("overwrite").partitionBy("shard").parquet(path)


def append_metrics(path: str, **metrics) -> None:
    with open(path, "a", encoding="utf-8") as out:
        out.write(json.dumps(metrics, sort_keys=True) + "\n")
