"""Connected components of an edge table by alternating star contractions.

Edges stay distributed; each round writes a new edge table to the shared folder, and the driver only sees two sums.
Each round sends at most two rows for an edge, so a star with a hub of any size stays linear, and its join is one that
adaptive execution can split. No join broadcasts a side, since that would go through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import exchanged, settle


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _to_smallest(directed: DataFrame, keep_self: bool) -> DataFrame:
    """For u with neighbours v: (v, smallest) pairs, where smallest is the least of u and its neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = directed.join(exchanged(least), "u")
    out = linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_self:
        out = out.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v")))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v); root is the least node that can be reached.

    Rows with a null or with u = v are no edges. An empty table gives an empty table.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = settle(edges)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour of u moves to the least of u's neighbourhood
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(exchanged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        small = _to_smallest(large, keep_self=True)
        edges = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
