"""Stratified splits and hard negatives, all by hash order, so that every run draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.config import Sampling


def bucket(n: Column) -> Column:
    """0, 1, 2-3 or 4+."""
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")


def _order(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *ids))


def strata_counts(s1: DataFrame) -> DataFrame:
    """(country, singleton, bucket, n) of (s1_id, country, matched)."""
    n = F.size("matched")
    return s1.groupBy("country", (n == 0).cast("int").alias("singleton"), bucket(n).alias("bucket")).agg(F.count("*").alias("n"))


def split(s1: DataFrame, n_train: int, n_validation: int, by_bucket: bool = True, settings: Sampling = Sampling()) -> DataFrame:
    """(s1_id, part): train and validation in proportion to strata of country, singleton and match count.

    A stratum gives max(1, round(size * share)) to each part from one hash order, train first; parts that come out too
    large lose their last ones by hash.
    """
    n = F.size("matched")
    stratum = ["country", "singleton"] + (["bucket"] if by_bucket else [])
    rows = s1.select("s1_id", "country", (n == 0).cast("int").alias("singleton"), bucket(n).alias("bucket"), _order(settings.seed, "s1_id").alias("o"))
    total = s1.count() or 1
    by_stratum = Window.partitionBy(*stratum)
    placed = rows.withColumns({"place": F.row_number().over(by_stratum.orderBy("o", "s1_id")), "size": F.count("*").over(by_stratum)})
    quota = lambda want: F.greatest(F.lit(1), F.round(F.col("size") * F.lit(want / total)).cast("int"))
    train, both = quota(n_train), quota(n_train) + quota(n_validation)
    parted = placed.withColumn("part", F.when(F.col("place") <= train, "train").when(F.col("place") <= both, "validation")).filter("part is not null")
    again = F.row_number().over(Window.partitionBy("part").orderBy("o", "s1_id"))
    most = F.when(F.col("part") == "train", n_train).otherwise(n_validation)
    return parted.withColumn("again", again).filter(F.col("again") <= most).select("s1_id", "part")


def hard_negatives(pairs: DataFrame, settings: Sampling = Sampling()) -> DataFrame:
    """All positives, and of each s1_id the negatives that look most like a match: max(3 * positives, 2) of them, where
    an entity without positives counts as one with one.

    Points: 5 for equal names, 4 core names, 3 house numbers, 2 postal numbers. Equal names and core names count even
    where both are empty, numbers only where they are given.
    """
    equal = lambda n, given: ((F.col(f"{n}_1") == F.col(f"{n}_2")) & ((F.col(f"{n}_1") != "") if given else F.lit(True))).cast("int")
    points = 5 * equal("name_norm", False) + 4 * equal("name_core", False) + 3 * equal("house_number", True) + 2 * equal("postal_candidate", True)
    positives = F.sum("label").over(Window.partitionBy("s1_id"))
    rows = pairs.withColumns({"hard": points, "positives": positives})
    place = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy(F.desc("hard"), "target_id"))
    want = F.greatest(settings.negatives_per_positive * F.greatest(F.col("positives"), F.lit(1)), F.lit(settings.least_negatives))
    return rows.withColumn("place", place).filter((F.col("label") == 1) | (F.col("place") <= want)).drop("place", "positives")


def banded_negatives(pairs: DataFrame, score: str = "best_score", settings: Sampling = Sampling()) -> DataFrame:
    """Positives and up to banded_negatives negatives of each s1_id with a positive: half of these (one at least) from the top
    of the score order, three tenths (one at least, of three and more) next to them, the rest by hash from what is left.
    Others give nothing."""
    by_s1 = Window.partitionBy("s1_id")
    rows = pairs.withColumn("positives", F.sum("label").over(by_s1)).filter("positives > 0")
    placed = rows.filter("label = 0").withColumns({"place": F.row_number().over(by_s1.orderBy(F.desc(score), "target_id")), "n": F.least(F.count("*").over(by_s1), F.lit(settings.banded_negatives))})
    share = lambda x: F.greatest(F.lit(1), F.floor(F.lit(x) * F.col("n")))
    sized = placed.withColumn("top", share(settings.top_share)).withColumn("near", F.col("top") + F.when(F.col("n") > 2, share(settings.middle_share)).otherwise(0))
    rest = sized.withColumns({"far": F.col("place") > F.col("near"), "o": _order(settings.seed, "s1_id", "target_id")})
    drawn = rest.withColumn("q", F.row_number().over(Window.partitionBy("s1_id", "far").orderBy("o", "target_id")))
    kept = drawn.filter(~F.col("far") | (F.col("q") <= F.col("n") - F.col("near")))
    return rows.filter("label = 1").select("s1_id", "target_id", "label").unionByName(kept.select("s1_id", "target_id", "label"))


def with_missed(candidates: DataFrame, truth: DataFrame, targets: DataFrame) -> DataFrame:
    """Training candidates (s1_id, target_id, missed): those found, and true targets that no channel found."""
    held = targets.select(F.col("entity_id").alias("target_id"))
    missed = truth.join(held, "target_id", "left_semi").select("s1_id", "target_id").distinct().join(candidates.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")
    return candidates.select("s1_id", "target_id", F.lit(0).alias("missed")).unionByName(missed.withColumn("missed", F.lit(1)))
