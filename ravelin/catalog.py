"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.queries import base, blocking, decisions, features, more, scalars, sources  # noqa: F401  (importing registers)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["win1_top_k"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
