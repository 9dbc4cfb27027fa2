"""Dealing rows over tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks of about `rows` rows each df makes; its rows are counted."""
    return math.ceil(df.count() / rows) or 1


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by the hash of keys over as many tasks as give each about `rows` of its rows.

    For wide rows that Spark's own sizes mistake: those are of compressed rows, and texts that are much alike take many times as
    much in memory. The rows are counted first; what is grouped or joined by the keys later stays where it is.
    """
    return df.repartition(tasks(df, rows), *keys)
