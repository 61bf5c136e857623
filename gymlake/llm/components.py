"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its least node.

    Each round hooks every root to its least neighbouring root, flattens the
    resulting trees by pointer jumping and contracts the edges, so the number of
    rounds goes with the logarithm of the longest path. Every round cuts its
    lineage in the shared folder. An empty table of edges gives no nodes.
    """
    left = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    found = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not left.isEmpty():
        parents = scratch.table(left.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent")))
        while True:
            above = parents.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
            jumped = scratch.table(parents.join(above, "parent", "left").select("child", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
            parents = jumped.select("child", "parent")
            if jumped.where("moved").isEmpty():
                break

        def up(df: DataFrame, column: str, parents=parents) -> DataFrame:
            moved = parents.select(F.col("child").alias(column), F.col("parent").alias("_to"))
            return df.join(moved, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        found = scratch.table(up(found, "component").select("node", "component"))
        left = scratch.table(up(up(left, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return found
