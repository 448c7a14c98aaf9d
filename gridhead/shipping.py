"""Sends the package to the executors, for sessions that were not started with it on their Python path."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


@functools.cache
def _archive(application: str) -> str:
    root = Path(__file__).parent
    target = f"{tempfile.mkdtemp(prefix='gridhead-')}/gridhead.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"gridhead/{p.relative_to(root)}")
    return target


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _sent:
        spark.sparkContext.addPyFile(_archive(application))
        _sent.add(application)
