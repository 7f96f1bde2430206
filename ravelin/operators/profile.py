"""Exploratory profiles of record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.numbers import pattern_flags


def columns(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """A row for each column: distinct values, share of blanks, length quantiles, shares with digits and beyond ASCII.

    One scan: the columns become rows before they are aggregated.
    """
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.coalesce(F.col(n).cast("string"), F.lit("")).alias("v")) for n in names))).alias("x")).select("x.*")
    size = F.length("v")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return long.groupBy("column").agg(
        F.countDistinct("v").alias("n_distinct"),
        share(F.trim("v") == "").alias("missing"),
        F.round(F.avg(size), 6).alias("mean_length"),
        *(F.round(F.percentile(size, p), 6).alias(f"length_p{int(p * 100)}") for p in (0.1, 0.5, 0.9)),
        share(F.col("v").rlike("[0-9]")).alias("with_digits"),
        share(F.col("v").rlike("[A-Za-z]")).alias("with_latin"),
        share(F.col("v").rlike(r"[^\x00-\x7F]")).alias("beyond_ascii"),
    )


def value_counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))


def duplicates(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row: groups of equal values, their rows, the largest group."""
    groups = rows.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest"))


def match_counts(truth: DataFrame) -> DataFrame:
    """How many matches entities have, without and with the singletons."""
    n = truth.select(F.size("matched").alias("n"))
    q = [F.round(F.percentile("n", p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return n.agg(F.count("*").alias("n_entities"), F.count_if(F.col("n") == 0).alias("n_singletons"), F.round(F.avg("n"), 6).alias("mean_n"), *q, F.max("n").cast("long").alias("max_n"))


def overlaps(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """(a, b, n): distinct values that two tables share, for each pair of tables."""
    keyed = [t.select(F.lower(F.trim(name)).alias("v"), F.lit(k).alias("t")) for k, t in tables.items()]
    seen = reduce(DataFrame.unionByName, keyed).filter("v <> ''").groupBy("v").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    pairs = F.flatten(F.transform("ts", lambda a: F.transform(F.filter("ts", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return seen.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def patterns(rows: DataFrame, name: str) -> DataFrame:
    """One row: how many values have each number, phone, mail, link and house pattern."""
    return rows.agg(*(F.count_if(c).alias(k) for k, c in pattern_flags(F.col(name)).items()))


def pair_exactness(pairs: DataFrame) -> DataFrame:
    """Shares of true pairs whose fields are equal."""
    return pairs.agg(F.count("*").alias("n_pairs"), *(F.round(F.avg((F.col(f"{c}_1") == F.col(f"{c}_2")).cast("double")), 6).alias(f"{c}_equal") for c in ("name_norm", "name_core", "address_norm", "house_number", "postal_candidate", "country_norm")))
