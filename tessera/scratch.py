"""Folders for derived tables, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


_temporary: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, or under a temporary one where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root and not _temporary:
        _temporary.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"{(root or _temporary[0]).rstrip('/')}/{name}-{uuid.uuid4().hex}"
