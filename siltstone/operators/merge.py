"""Merging, ordering, numbering and summing up of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_merge(df: DataFrame, keys: list[str], eligible: Column, merged: dict[str, Column], single: dict[str, Column]) -> DataFrame:
    """One row a group of eligible rows, and every other row on its own.

    merged has the aggregate of each output column, single the column of a row that stands alone. Rows that are not
    eligible never meet, so null keys don't group.
    """
    elig = F.coalesce(eligible, F.lit(False))
    groups = df.where(elig).groupBy(*keys).agg(*[c.alias(k) for k, c in merged.items()])
    alone = df.where(~elig).select(*keys, *[c.alias(k) for k, c in single.items()])
    return groups.unionByName(alone)


def ranked_union(ranks: str) -> Column:
    """Aggregate: the distinct ranks of a group, in order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(ranks)), lambda x: x.cast("string")), ",")


def first_with(value: str, present: Column, order: Column) -> Column:
    """Aggregate: value of the first row in order that has it, else of the first row."""
    return F.min_by(value, F.struct((~present).alias("absent"), order.alias("order")))


def numbered(df: DataFrame, within: list[str], order: list, name: str = "id") -> DataFrame:
    """df with 1..n in a total order within each report."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("bigint"))


def zero_filled(df: DataFrame, dimensions: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """How many rows of df each row of dimensions has, zeros kept."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(name))
    return dimensions.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def exploded_counts(df: DataFrame, values: Column, name: str) -> DataFrame:
    """How many rows have each value of an array; a row counts once for each value it has."""
    return df.select(F.explode(F.array_distinct(values)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def worst(df: DataFrame, keys: list[str], rank: Column, names: list[str], name: str = "status") -> DataFrame:
    """The name of the largest rank of each group; ranks count from 0 in the order of names."""
    label = F.element_at(F.array(*map(F.lit, names)), F.col("_worst") + 1)
    return df.groupBy(*keys).agg(F.max(rank).alias("_worst")).select(*keys, label.alias(name))
