"""Cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame

#: Whether Spark removes the files of a query's shuffles when it ends.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, the files of its shuffles removed.

    The folder is the session's spark.checkpoint.dir; where none is set, one of this machine, if all runs on it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siltstone-"))
    before = spark.conf.get(_CLEANS)
    spark.conf.set(_CLEANS, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # select: a query of its own, made under the setting
    finally:
        spark.conf.set(_CLEANS, before)
