"""Candidate tables: union with neighbours, prescores, top-K, pruning, pair assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.config import Lists, Ranking
from ravelin.functions.similarity import jaccard


def with_neighbours(blocks: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Deterministic candidates and neighbours (s1_id, target_id, score, ann_rank) as one table.

    A pair of both keeps its channels; several hits of a neighbour keep the best score and the first rank. block_count
    counts channels only.
    """
    near = neighbours.groupBy("s1_id", "target_id").agg(F.max("score").alias("ann_score"), F.min("ann_rank").alias("ann_rank"))
    both = blocks.join(near, ["s1_id", "target_id"], "full")
    return both.select(
        "s1_id", "target_id",
        F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"),
        F.coalesce("block_count", F.lit(0)).cast("long").alias("block_count"),
        F.coalesce("rare_w", F.lit(0.0)).alias("rare_w"),
        F.col("ann_score").isNotNull().alias("hit_ann"),
        F.coalesce("ann_rank", F.lit(99)).alias("ann_rank"),
        F.coalesce("ann_score", F.lit(0.0)).alias("ann_score"),
    )


PAIR_COLUMNS = ("name_norm", "name_translit", "name_core", "name_compact", "name_tokens", "address_norm", "address_translit", "address_tokens", "house_number", "numeric_tokens", "numeric_signature", "postal_candidate", "address_missing", "country_norm")

#: What the prescore needs of them.
SCORE_COLUMNS = ("name_norm", "name_core", "name_translit", "house_number", "numeric_tokens", "address_tokens")


def sides(candidates: DataFrame, queries: DataFrame, targets: DataFrame, columns: tuple[str, ...] = PAIR_COLUMNS) -> DataFrame:
    """candidates with both records' columns, named *_1 and *_2; pairs without a record go."""
    left = queries.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"{c}_1") for c in columns))
    right = targets.select(F.col("entity_id").alias("target_id"), *(F.col(c).alias(f"{c}_2") for c in columns))
    return candidates.join(left, "s1_id").join(right, "target_id")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where (s1_id, target_id) is in the truth."""
    known = truth.select("s1_id", "target_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(known, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def _equal(name: str) -> Column:
    a, b = F.col(f"{name}_1"), F.col(f"{name}_2")
    return ((a != "") & (a == b)).cast("double")


def score_parts(settings: Ranking = Ranking(), overlap: Callable[..., Column] = jaccard) -> dict[str, Column]:
    """What the prescore takes from both sides' columns. overlap compares their tokens."""
    w = settings
    alike = (
        w.exact * _equal("name_norm")
        + w.core * _equal("name_core")
        + w.translit * _equal("name_translit")
        + w.house * _equal("house_number")
        + w.numeric * overlap(F.col("numeric_tokens_1"), F.col("numeric_tokens_2"), both_empty=0.0)
    )
    return {"alike": alike, "near": w.address * overlap(F.col("address_tokens_1"), F.col("address_tokens_2"))}


def prescore(settings: Ranking = Ranking(), parts: dict[str, Column] | None = None) -> Column:
    """The cheap score of a pair with both sides' columns, or with the parts made of them."""
    w, parts = settings, parts or score_parts(settings)
    return (
        parts["alike"]
        + w.rare * F.least(F.col("rare_w") / w.rare_scale, F.lit(w.rare_most))
        + F.when(F.col("hit_ann"), w.ann * F.col("ann_score")).otherwise(0.0)
        + parts["near"]
        + w.block * F.col("block_count")
    )


def ranked(pairs: DataFrame, k: int, score: Column, by: tuple[str, ...] = ("s1_id",)) -> DataFrame:
    """The k best pairs of each s1_id: by score (to nine places), then by the higher target id; block_rank counts from 0. by may
    have more columns that follow from s1_id."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("prescore"), F.desc("target_id")))
    return pairs.withColumn("prescore", F.round(score, 9)).withColumn("block_rank", place).filter(F.col("block_rank") <= k).withColumn("block_rank", F.col("block_rank") - 1)


def cheap_score() -> Column:
    """The union's score of a pair with evidence flags."""
    return 5 * F.col("exact_name") + 4 * F.col("exact_address") + 2 * F.least(F.col("n"), F.lit(4)) + F.col("best_score") + 3 * F.col("e5") - 0.01 * F.least(F.col("best_rank"), F.lit(500))


def prune(pairs: DataFrame, k: int, score: str = "cheap") -> DataFrame:
    """k pairs of each s1_id: exact ones and those of three channels first, then the best; in the union's order."""
    must = ((F.col("exact_name") == 1) | (F.col("exact_address") == 1) | (F.col("n") >= 3)).cast("int")
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(must), F.desc(score), "target_id"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def adaptive_prune(pairs: DataFrame, settings: Lists = Lists(), score: str = "cheap") -> DataFrame:
    """Two levels: `inner` pairs as prune keeps them, of them `final`, with strong evidence first."""
    strong = ((F.col("exact_name") == 1) | (F.col("exact_address") == 1) | (F.col("n") >= 2) | (F.col("e5") >= 0.5)).cast("int")
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("strong"), F.desc(score), "target_id"))
    return prune(pairs, settings.inner, score).withColumn("strong", strong).withColumn("place", place).filter(F.col("place") <= settings.final)


def as_lists(candidates: DataFrame, order: str, name: str = "candidates") -> DataFrame:
    """(s1_id, candidates): targets in the order of a column."""
    return candidates.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "target_id"))), lambda x: x["target_id"]).alias(name))
