"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


#: The temporary folder of each local session that names none.
_LOCAL: dict[str, str] = {}


def shared_folder(spark) -> str:
    """The session's spark.checkpoint.dir; only a local session that has none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark.sparkContext.applicationId
        base = _LOCAL[at] = _LOCAL.get(at) or tempfile.mkdtemp(prefix="tessella-")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: later jobs see the same rows even if executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/tessella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
