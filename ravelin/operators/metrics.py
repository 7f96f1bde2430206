"""Evaluation: recall of candidate lists, F0.5, precision and recall over entities, reports, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "array<string>"


def _lists(c: str) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def candidate_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: micro and macro recall. Entities without matches count as 1 in macro and not at all in micro."""
    joined = truth.join(candidates, "s1_id", "left").select(F.size(F.array_intersect("matched", _lists("candidates"))).alias("hit"), F.size("matched").alias("n"))
    return hit_recall(joined)


def hit_recall(counted: DataFrame) -> DataFrame:
    """candidate_recall from (hit, n) of each entity: matches among its candidates, and all matches."""
    share = F.when(F.col("n") == 0, 1.0).otherwise(F.col("hit") / F.greatest("n", F.lit(1)))
    micro = F.sum("hit") / F.greatest(F.sum("n"), F.lit(1))
    return counted.agg(F.round(micro, 6).alias("micro_recall"), F.round(F.avg(share), 6).alias("macro_recall"))


def blocking_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """The variant over candidate rows: micro is 1 where there is no truth."""
    joined = candidates.join(truth, "s1_id", "left").select(F.size(F.array_intersect(_lists("matched"), "candidates")).alias("hit"), F.size(_lists("matched")).alias("n"))
    share = F.when(F.col("n") == 0, 1.0).otherwise(F.col("hit") / F.greatest("n", F.lit(1)))
    micro = F.when(F.coalesce(F.sum("n"), F.lit(0)) == 0, 1.0).otherwise(F.sum("hit") / F.greatest(F.sum("n"), F.lit(1)))
    return joined.agg(F.round(micro, 6).alias("micro_recall"), F.round(F.avg(share), 6).alias("macro_recall"))


def recall_sweep(ranked: DataFrame, truth: DataFrame, grid: tuple[int, ...]) -> DataFrame:
    """(k, micro_recall, macro_recall) for several list lengths from one ranked table (block_rank from 0)."""
    pairs = truth.select("s1_id", F.explode("matched").alias("target_id"))
    found = pairs.join(ranked.select("s1_id", "target_id", "block_rank"), ["s1_id", "target_id"], "left")
    counts = found.groupBy("s1_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("block_rank") < k).alias(f"k{k}") for k in grid))
    every = truth.select("s1_id").join(counts, "s1_id", "left")
    rows = every.select(F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"k{k}", F.lit(0)).alias("hit")) for k in grid))).alias("x")).select("n", "x.*")
    share = F.when(F.col("n") == 0, 1.0).otherwise(F.col("hit") / F.greatest("n", F.lit(1)))
    return rows.groupBy("k").agg(F.round(F.sum("hit") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("micro_recall"), F.round(F.avg(share), 6).alias("macro_recall"))


def count_stats(s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of an entity: mean, quantiles, least and most, share of entities with any."""
    n = s1.select("s1_id").join(candidates, "s1_id", "left").select(F.size(_lists("candidates")).alias("n"))
    return size_stats(n)


def size_stats(n: DataFrame) -> DataFrame:
    """count_stats from the number n of each entity's candidates."""
    q = [F.round(F.percentile("n", p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]
    return n.agg(F.round(F.avg("n"), 6).alias("avg_n"), *q, F.max("n").cast("long").alias("max_n"), F.min("n").cast("long").alias("min_n"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("coverage"))


def within_budget(stats: DataFrame, most: float = 15.0, strict: bool = True) -> bool:
    """Is the mean number of candidates within the budget? ValueError where it isn't and strict is set."""
    mean = stats.first().avg_n or 0.0
    if mean > most and strict:
        raise ValueError(f"{mean:.2f} candidates an entity on average; the budget is {most:g}")
    return mean <= most


def entity_scores(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(s1_id, n_truth, n_pred, hit, precision, recall, f05) over the entities of either table.

    Both empty: all 1. One empty: all 0.
    """
    joined = truth.select("s1_id", F.col("matched").alias("t")).join(predictions.select("s1_id", F.col("matched").alias("p")), "s1_id", "full")
    return counted_scores(joined.select("s1_id", F.size(_lists("t")).alias("n_truth"), F.size(_lists("p")).alias("n_pred"), F.size(F.array_intersect(_lists("t"), _lists("p"))).alias("hit")))


def counted_scores(sized: DataFrame) -> DataFrame:
    """entity_scores from (s1_id, n_truth, n_pred, hit)."""
    empty = (F.col("n_truth") == 0) & (F.col("n_pred") == 0)
    p = F.when(empty, 1.0).otherwise(F.col("hit") / F.greatest("n_pred", F.lit(1)))
    r = F.when(empty, 1.0).otherwise(F.col("hit") / F.greatest("n_truth", F.lit(1)))
    scored = sized.withColumns({"precision": p, "recall": r})
    f = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 1.25 * F.col("precision") * F.col("recall") / (0.25 * F.col("precision") + F.col("recall"))).otherwise(0.0)
    return scored.withColumn("f05", f)


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.avg("precision"), 6).alias("macro_p"), F.round(F.avg("recall"), 6).alias("macro_r"), F.count("*").alias("n_entities"))


def size_report(scores: DataFrame) -> DataFrame:
    """macro() for all entities and for each truth size 0, 1, 2, 3+, in one pass of grouping sets."""
    bucket = F.when(F.col("n_truth") >= 3, "3+").otherwise(F.col("n_truth").cast("string"))
    return scores.withColumn("bucket", bucket).rollup("bucket").agg(
        F.count("*").alias("n_entities"), F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.avg("precision"), 6).alias("macro_p"), F.round(F.avg("recall"), 6).alias("macro_r")
    ).select(F.coalesce("bucket", F.lit("all")).alias("bucket"), "n_entities", "macro_f05", "macro_p", "macro_r")


def sweep(scored: DataFrame, truth: DataFrame, settings: list[tuple[float, ...]], names: tuple[str, ...], accept) -> DataFrame:
    """(*names, macro_f05) for each setting, all from one pass over the scored pairs.

    scored has s1_id, target_id, p and label; accept(setting) is a condition on a pair. Counts per entity are exact: what a
    setting accepts is counted by partial sums, so nothing grows with the number of settings but columns.
    """
    hits = [F.count_if(accept(s) & (F.col("label") == 1)).alias(f"h{k}") for k, s in enumerate(settings)]
    told = [F.count_if(accept(s)).alias(f"n{k}") for k, s in enumerate(settings)]
    per_entity = scored.groupBy("s1_id").agg(*hits, *told)
    sizes = truth.select("s1_id", F.size("matched").alias("n_truth"))
    every = sizes.join(per_entity, "s1_id", "full")
    rows = every.select(
        F.coalesce("n_truth", F.lit(0)).alias("t"),
        F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("h"), F.coalesce(f"n{k}", F.lit(0)).alias("n")) for k in range(len(settings))))).alias("x"),
    ).select("t", "x.*")
    p, r = F.col("h") / F.greatest("n", F.lit(1)), F.col("h") / F.greatest("t", F.lit(1))
    f = F.when((F.col("t") == 0) & (F.col("n") == 0), 1.0).when(F.col("h") == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    means = rows.groupBy("k").agg(F.round(F.avg(f), 6).alias("macro_f05"))
    values = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(names, s, strict=True))) for s in settings))
    return means.select(*(F.element_at(values, F.col("k") + 1)[n].alias(n) for n in names), "macro_f05", "k")


def best(swept: DataFrame) -> tuple:
    """The setting with the highest score; of equal ones the first."""
    return tuple(swept.orderBy(F.desc("macro_f05"), "k").first())[:-1]


def tune(scored: DataFrame, truth: DataFrame, grid: tuple[float, ...], steps: tuple[float, ...] = (-0.04, -0.02, 0.02, 0.04), low: float = 0.2, high: float = 0.97) -> tuple[float, float, float]:
    """(threshold for S2, threshold for S3, macro F0.5): a coarse grid, steps around the moving best, then 3 x 3 a source."""
    single = lambda s: F.col("p") >= s[0]
    threshold, value = best(sweep(scored, truth, [(g,) for g in grid], ("threshold",), single))
    for step in steps:
        near = round(min(high, max(low, threshold + step)), 4)
        got = best(sweep(scored, truth, [(near,)], ("threshold",), single))
        if got[1] > value:
            threshold, value = got
    pairs = [(round(threshold + a, 4), round(threshold + b, 4)) for a in (-0.05, 0.0, 0.05) for b in (-0.05, 0.0, 0.05)]
    by_source = lambda s: F.col("p") >= F.when(F.col("target_id").startswith("S2-"), s[0]).otherwise(s[1])
    return best(sweep(scored, truth, pairs, ("t2", "t3"), by_source))


def miss_kinds(pairs: DataFrame, high: float = 0.5) -> DataFrame:
    """(kind, n) of missed true pairs by how alike name and address are; pairs has name_jaccard and address_jaccard."""
    n, a = F.col("name_jaccard") >= high, F.col("address_jaccard") >= high
    kind = F.when(n & a, "both").when(n, "name").when(a, "address").otherwise("neither")
    return pairs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
