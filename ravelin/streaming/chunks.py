"""Micro-batches of reference records against a static target side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ravelin.sources.tables import RECORDS, without_done


def link_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, link: Callable[[DataFrame], DataFrame], files_at_once: int = 1, file_format: str = "csv") -> StreamingQuery:
    """Starts a query that links each new file of `folder` by link(records) and appends the rows to Parquet in `output`.

    link is the batch plan over the static side. Its checkpoint makes a started-over query go on after the last batch;
    a batch that was cut off is repeated as a whole, and rows of entities that are in the output already are left out, so
    each entity is written once. All available files are worked off, then the query ends.
    """
    reader = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_at_once)
    if file_format == "csv":
        reader = reader.option("sep", "\t").option("header", True)
    stream = reader.format(file_format).load(folder)

    def step(batch: DataFrame, number: int) -> None:
        found = link(batch.fillna(""))
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(output)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            found = without_done(found, spark.read.schema(found.schema).parquet(output))
        found.write.mode("append").parquet(output)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_mode(seconds_left: float, seconds_needed: dict[str, float]) -> str:
    """The first of FULL, FAST and SAFE_BASELINE that fits into the time that is left."""
    for mode in ("FULL", "FAST"):
        if seconds_needed.get(mode, 0.0) <= seconds_left:
            return mode
    return "SAFE_BASELINE"
