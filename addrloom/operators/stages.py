"""Cutting a plan into stages, so that a result that several branches read is computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only in local mode, where it is unset, is a temporary one made."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if context.master.partition("[")[0] != "local":
                raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="addrloom-stages-")
            _OWN.append(named)
            atexit.register(shutil.rmtree, named, True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder. A lost executor costs no more than the stage at hand."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
