"""Code for Python tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python functions resolve there."""
    if getattr(spark.sparkContext, "_strataloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="strataloom-code-"), "strataloom_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._strataloom_shipped = True
