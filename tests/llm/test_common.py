"""What the corpus operators leave in memory and on disk."""

from __future__ import annotations

import os
import time

import pyarrow as pa
from pyspark.sql import functions as F

from ravelin.llm.common import settle, through_arrow


def test_memory_is_given_back(spark):
    """What a task took doesn't stay with its worker, though something later lies behind it."""

    def run(batches):
        import os

        from ravelin.llm import common

        resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
        for _ in batches:
            many = [bytes([k % 251]) * 20_000 for k in range(15_000)]
            kept = [b"x" * 20_000]
            most = resident()
            del many
            common.release()
            yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([resident() + 0 * len(kept)])], names=["most", "after"])

    row = through_arrow(spark.range(1).coalesce(1), run, "most long, after long").first()
    assert row.most - row.after > 200


def test_exchanges_of_a_settled_frame_go(spark):
    """What was exchanged for a settled frame is off the disk soon; the frame it was made of can run after that."""
    folders = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    made = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = files()
    settled = settle(made)
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert sorted(settled.collect()) == sorted(made.collect()) and settled.agg(F.sum("n")).first()[0] == 1000
    assert sorted(settle(made).collect()) == sorted(made.collect())
