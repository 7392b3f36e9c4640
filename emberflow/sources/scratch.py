"""Paths in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="emberflow-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
