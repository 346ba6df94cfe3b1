"""Intermediate results in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; without it, a temporary one on this machine if all runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="quillgraph-"))
    return _local[0]


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors see."""
    return f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder, so that it is computed once and outlives an executor.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go once nothing refers to them.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager=True)
