"""Connected components by alternating stars, on edge tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import settled

#: Edges of a partition, and the partitions that any number of edges gets.
EDGES, LEAST_PARTS = 500_000, 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the least node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to the least node that it sees; it ends when
    a round changes nothing. Rounds grow with the logarithm of the component's size. A node of very many neighbours is
    split where it meets its least one: that is kept as a table first, so that Spark may split the join. Few edges are held
    in few partitions. Null ends and loops are left out; without edges there are no rows.
    """
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = settled(current.where((F.col(a) != F.col(b))).distinct())
    state = (current.count(), None)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parts = max(LEAST_PARTS, state[0] // EDGES)
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.withColumnRenamed("m", "v"))
        current = settled(small.distinct().coalesce(parts))
        summed = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(summed) == tuple(state):
            break
        state = summed
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
