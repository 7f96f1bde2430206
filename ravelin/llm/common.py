"""Pieces that the corpus operators share: reading, lineage cuts and row-wise Arrow stages."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.frames import settle, shared_folder
from ravelin.shipping import ship

#: What internal columns' names begin with; see sheltered.
INTERNAL = "__"
#: Internal row number. One is given to each row, so that repeated or null ids stay separate rows.
RID = "__ravelin_rid"
#: A Python function gets so many bytes of rows at once at most, or one row.
BATCH_BYTES = 32 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: The white space that parts words: space and the five controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def exchanged(df: DataFrame) -> DataFrame:
    """df for a join that exchanges both sides. A table that is broadcast goes through the driver, and those of many rounds are
    there at the same time, up to Spark's size limit each."""
    return df.hint("merge")


#: Plan nodes whose rows come in the same order and partitions whenever they are made.
_STEADY = {"Project", "Filter", "LogicalRDD", "LocalRelation", "LogicalRelation", "RelationV2", "DataSourceV2ScanRelation", "Range", "SubqueryAlias", "OneRowRelation"}


def numbered(df: DataFrame) -> DataFrame:
    """df with RID, which is unique and the same however often the result is made.

    A scan gives its rows in the same order and partitions each time. Rows of any other plan (a shuffle, a join, a sort) are
    written first, so that a task that runs again can't number them otherwise.
    """
    nodes = re.findall(r"^[\s:+|-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    if not {n for n in nodes if n != "Relation"} <= _STEADY:
        df = settle(df)
    return df.drop(RID).withColumn(RID, F.monotonically_increasing_id())


def sheltered(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of a table and column names that adds internal columns for a while: columns of the table whose names could
    clash with these have others meanwhile."""

    @functools.wraps(work)
    def run(docs: DataFrame, *names, **more) -> DataFrame:
        clash = [c for c in docs.columns if c.startswith(INTERNAL)]
        if not clash:
            return work(docs, *names, **more)
        taken = {c.lower() for c in docs.columns}
        away: dict[str, str] = {}
        for c in clash:
            k = len(away)
            while f"kept{k}" in taken:
                k += len(clash)
            taken.add(f"kept{k}")
            away[c] = f"kept{k}"
        swap = lambda x: away.get(x, x) if isinstance(x, str) else x
        out = work(docs.withColumnsRenamed(away), *map(swap, names), **{k: swap(x) for k, x in more.items()})
        return out.withColumnsRenamed({new: old for old, new in away.items()})

    return run


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(whole: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, and of BATCH_BYTES or one row."""
    at = 0
    while at < whole.num_rows:
        n = min(rows, whole.num_rows - at)
        while n > 1 and whole.slice(at, n).nbytes > BATCH_BYTES:
            n //= 2
        yield whole.slice(at, n)
        at += n


def release() -> None:
    """Gives memory that is free back to the machine. Python's workers live on between tasks, and what the largest task took
    would stay with each of them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def through_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow for functions of this package."""
    ship(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def arrow_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], fields: list[T.StructField], drop: tuple[str, ...] = (), rows: int = 2048
) -> DataFrame:
    """df with new columns that a Python function makes from Arrow batches, row by row in place.

    make runs once in each task and returns the function, so that tables are built once. Existing columns with the
    names of the new ones are replaced. Columns in drop go. Batches are cut to a bounded number of rows.
    """
    names = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)
    want = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for whole in batches:
            if work is None:
                work = make()
            for part in slices(whole, rows):
                new = work(part)
                yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(part.schema.get_field_index(n)) for n in want], names=want)

    return through_arrow(df, run, schema)


def arrow_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, rows: int = 2048) -> DataFrame:
    """The rows that a Python function makes from each Arrow batch, in batches of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for whole in batches:
            if work is None:
                work = make()
            for part in slices(whole, rows):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return through_arrow(df, run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
