"""Similarities of token arrays and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared over all distinct tokens; one empty side gives 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def set_jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """jaccard of arrays without repeats: what is shared tells the number of all."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(both_empty)).otherwise(shared / F.greatest(union, F.lit(1)))


def numbers_of(tokens: Column) -> Column:
    """Distinct tokens as numbers, their hashes: sets of numbers are compared without objects."""
    return F.transform(F.array_distinct(tokens), lambda t: F.xxhash64(t))


def same(a: Column, b: Column) -> Column:
    """1 where both are given and equal."""
    return ((a != "") & (a == b)).cast("int")


def differ(a: Column, b: Column) -> Column:
    """1 where both are given and not equal."""
    return ((a != "") & (b != "") & (a != b)).cast("int")


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / (F.greatest(F.length(a), F.length(b)) + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector by its length, which counts 1e-12 more."""
    size = norm(a) + 1e-12
    return F.transform(a, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def hashed_counts(tokens: Column, size: int = 256) -> Column:
    """A token's place is its MD5 modulo 256, the value of its last two hex digits; the vector counts places."""
    places = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 31, 2), 16, 10).cast("int"))
    counted = F.aggregate(
        F.array_sort(places),
        F.array().cast("array<struct<i:int,n:int>>"),
        lambda a, i: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["i"] == i), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(i.alias("i"), (F.try_element_at(a, F.lit(-1))["n"] + 1).alias("n"))))).otherwise(
            F.concat(a, F.array(F.struct(i.alias("i"), F.lit(1).alias("n"))))
        ),
    )
    # bound as a lambda's variable, so that the map is made once and not for each place
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("double"))
    return F.element_at(F.transform(F.array(F.map_from_entries(counted)), dense), 1)
