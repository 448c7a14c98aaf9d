"""Paths in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own_folder(application: str) -> str:
    """A temporary folder for a session that names none (tests on one machine)."""
    return tempfile.mkdtemp(prefix="gridhead-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share: `spark.checkpoint.dir`. Only a session on one machine may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or _own_folder(spark.sparkContext.applicationId)).rstrip('/')}/{label}-{uuid.uuid4().hex}"
