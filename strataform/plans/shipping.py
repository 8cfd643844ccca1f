"""Sends this package to the executors, which may have no copy of it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = __name__.split(".")[0]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each context; needed where functions of this package run in Python workers."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(prefix=f"{PACKAGE}-code-"), f"{PACKAGE}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{PACKAGE}/{p.relative_to(top)}")
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)
