"""Sends this package to Spark's Python workers, for sessions whose executors don't have it installed."""
from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application. Call it before a plan with Python functions is run."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="quarterdeck-code-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as held:
        for file in sorted(root.rglob("*.py")):
            held.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _SENT.add(context.applicationId)
