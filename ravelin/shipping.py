"""Brings this package to the Python workers of a session that can't import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Once for each Spark context; nothing happens where PYTHONPATH, which workers inherit, has the package's folder."""
    context = spark.sparkContext
    if getattr(context, "_ravelin_shipped", False):
        return
    context._ravelin_shipped = True
    if str(_ROOT) in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    archive = Path(tempfile.mkdtemp(prefix="ravelin-package-")) / "ravelin-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted((_ROOT / "ravelin").rglob("*.py")):
            out.write(source, source.relative_to(_ROOT))
    context.addPyFile(str(archive))
