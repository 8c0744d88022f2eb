"""Cutting a plan's lineage so that lost executors cost a re-read, not a re-run."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the session names none, a folder of our own is set, and only for a
    single-machine master: on a cluster a machine-local folder would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None:
        named = context._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if named is None:
        master = context.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="folioforge-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)
