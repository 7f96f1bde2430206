"""Frames that are written before others are made of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Tells Spark to remove an execution's shuffle files at its end; a frame has what holds when it is made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class NoFolder(ValueError):
    """No folder that all executors share is known."""


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a local session may do without: it gets a folder of the
    driver's own, which no other machine could reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise NoFolder("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"ravelin-{purpose}-")


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage.

    Spark removes the files with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set. What was exchanged
    for the frame goes as soon as it is written, and not only when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoint"))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # a frame of its own: df may have run already, and can be run again
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """df settled where the session has a folder for that, and as it is elsewhere."""
    try:
        return settle(df)
    except NoFolder:
        return df
