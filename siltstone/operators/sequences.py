"""Sequences: pages, chains of revisions, spans, latest decisions, running limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.settle import settled


def page_sequence(df: DataFrame, key: str, index: str, first: int = 0) -> DataFrame:
    """Whether each key's pages are distinct and run from `first` without a gap."""
    i = F.col(index)
    out = df.groupBy(key).agg(F.count("*").alias("pages"), F.count_distinct(i).alias("_d"), F.min(i).alias("_lo"), F.max(i).alias("_hi"))
    ok = (F.col("pages") == F.col("_d")) & (F.col("_lo") == first) & (F.col("_hi") == first + F.col("pages") - 1)
    return out.select(key, "pages", ok.alias("complete"))


def chain(df: DataFrame, key: str, revision: str, content: Column) -> DataFrame:
    """Each revision with its content's SHA-256, that of the one before, and whether their numbers are consecutive."""
    w = Window.partitionBy(key).orderBy(revision)
    out = df.withColumn("digest", F.sha2(content, 256))
    return out.withColumns({"previous": F.coalesce(F.lag("digest").over(w), F.lit("")), "contiguous": F.coalesce(F.col(revision) - F.lag(revision).over(w) == 1, F.lit(True))})


def overlaps(df: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """Spans of a key that the next one, by start, begins within."""
    w = Window.partitionBy(key).orderBy(start, order)
    return df.withColumn("next_start", F.lead(start).over(w)).where(F.col("next_start") < F.col(end))


def latest(df: DataFrame, keys: list[str], deciding: Column, order: Column, value: str) -> DataFrame:
    """The value of each key's latest deciding row by a total order."""
    return df.where(deciding).groupBy(*keys).agg(F.max_by(value, order).alias("state"))


def inversions(df: DataFrame, key: str, at: str, number: str) -> DataFrame:
    """How many rows of each key have a larger number than a later row: next to each other in time."""
    w = Window.partitionBy(key).orderBy(at, number)
    return df.withColumn("_next", F.lead(number).over(w)).groupBy(key).agg(F.count_if(F.col("_next") < F.col(number)).alias("inversions"))


def duplicates(df: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Of each key: "single", "duplicate" (equal contents) or "conflict" (others)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.sha2(content, 256)).alias("_d"))
    return out.select(*keys, "n", F.when(F.col("n") == 1, "single").when(F.col("_d") == 1, "duplicate").otherwise("conflict").alias("state"))


def running_cap(df: DataFrame, key: str, order: list[str], size: str, most: int) -> DataFrame:
    """Rows with the running total of their key, and whether it is still within the cap; the order is total within a key.

    Totals are taken within range partitions by key and order, so that no task holds all rows of a frequent key; what
    stands before a partition's rows of a key comes from the sums of the partitions before.
    """
    held = settled(df.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = held.groupBy("_p", F.col(key).alias("_key")).agg(F.sum(size).alias("_sum"))  # a row a key and partition
    before = sums.select(F.col("_p").alias("_q"), "_key", (F.sum("_sum").over(Window.partitionBy("_key").orderBy("_p")) - F.col("_sum")).alias("_before"))
    out = held.withColumn("_own", F.sum(size).over(inside)).join(before, (F.col("_p") == F.col("_q")) & F.col(key).eqNullSafe(F.col("_key")))
    out = out.withColumn("running", F.col("_own") + F.col("_before"))
    return out.withColumn("within", F.col("running") <= most).drop("_p", "_q", "_key", "_own", "_before")


def top(df: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)
