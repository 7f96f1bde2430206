"""The output contract's rules, one query each; all give (rule, severity, offender)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = {
    "VAL1": "file missing or empty", "VAL2": "separated by commas", "VAL3": "wrong header", "VAL4": "row without a tab", "VAL5": "row repeated",
    "VAL6": "id repeated in a list", "VAL7": "S1 id as a target", "VAL8": "id without a target prefix", "VAL9": "unknown id", "VAL10": "row missing or not asked for",
    "VAL11": "match that is no candidate",
}


def _found(rule: str, offender: Column, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit("warning" if rule == "VAL11" else "error").alias("severity"), offender.cast("string").alias("offender"))


def _ids(cell: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def file_rules(spark: SparkSession, path: str, header: tuple[str, ...]) -> DataFrame:
    """VAL1 to VAL4, on the file's lines. The header is compared without case and outer spaces."""
    none = spark.createDataFrame([], "rule string, severity string, offender string")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return _found("VAL1", F.lit(path), spark.range(1))
    lines = spark.read.text(path)
    first = lines.first()
    if first is None or not first[0].strip():
        return _found("VAL1", F.lit(path), spark.range(1))
    top = first[0].lstrip("﻿")
    if "\t" not in top and "," in top:
        return _found("VAL2", F.lit(top), spark.range(1))
    if tuple(x.strip().lower() for x in top.split("\t")) != tuple(h.lower() for h in header):
        return _found("VAL3", F.lit(top), spark.range(1))
    bad = lines.filter((F.trim("value") != "") & ~F.contains("value", F.lit("\t")))
    return none.unionByName(_found("VAL4", F.col("value"), bad))


def list_rules(rows: DataFrame, cell: str, required: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """VAL5 to VAL10 on (source1_entity_id, cell). required is the S1 ids' table, known the targets' (entity_id)."""
    rows = rows.select(F.col("source1_entity_id").alias("s1"), _ids(cell).alias("ids"))
    each = rows.select("s1", F.explode("ids").alias("id"))
    parts = [
        _found("VAL5", F.col("s1"), rows.groupBy("s1").count().filter("count > 1")),
        _found("VAL6", F.col("s1"), rows.filter(F.size("ids") != F.size(F.array_distinct("ids")))),
        _found("VAL7", F.concat_ws(":", "s1", "id"), each.filter(F.col("id").startswith("S1-"))),
        _found("VAL8", F.concat_ws(":", "s1", "id"), each.filter(~F.col("id").rlike("^S[123]-"))),
    ]
    if known is not None:
        good = each.filter(F.col("id").rlike("^S[23]-"))
        parts.append(_found("VAL9", F.concat_ws(":", "s1", "id"), good.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")))
    if required is not None:
        want = required.select(F.col("s1_id").alias("s1")).distinct()
        parts.append(_found("VAL10", F.concat(F.lit("missing:"), "s1"), want.join(rows.select("s1"), "s1", "left_anti")))
        parts.append(_found("VAL10", F.concat(F.lit("extra:"), "s1"), rows.select("s1").distinct().join(want, "s1", "left_anti")))
    return reduce(DataFrame.unionByName, parts)


def subset_rule(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """VAL11: rows whose matches aren't all candidates."""
    m = matching.select(F.col("source1_entity_id").alias("s1"), _ids("matched_entity_ids").alias("m"))
    c = candidates.groupBy(F.col("source1_entity_id").alias("s1")).agg(F.flatten(F.collect_list(_ids("candidate_entity_ids"))).alias("c"))
    joined = m.join(c, "s1", "left")
    return _found("VAL11", F.col("s1"), joined.filter(F.size(F.array_except("m", F.coalesce("c", F.array().cast("array<string>")))) > 0))


def validate(matching: DataFrame, candidates: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All rules on tables; no error row means that the output holds the contract."""
    return list_rules(matching, "matched_entity_ids", required, known).unionByName(list_rules(candidates, "candidate_entity_ids", required, known)).unionByName(subset_rule(matching, candidates))
