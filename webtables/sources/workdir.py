"""Folders that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Shared folder named by the session; only a local session may fall back to a temporary one."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    return tempfile.mkdtemp(prefix="webtables-")


def fresh_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder; nothing that exists is ever overwritten."""
    return f"{shared_folder(spark)}/webtables/{name}-{uuid.uuid4().hex}"
