"""Gives the executors' Python workers this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Add the package's code to the session's files, once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_sparrel_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sparrel"), "sparrel_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    sc.addPyFile(path)
    sc._sparrel_shipped = True
