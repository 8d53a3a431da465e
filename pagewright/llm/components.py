"""Distributed connected components by alternating star contractions.

Only DataFrame operations: every round rewrites the edge table so that each
node points at a smaller node of its component, until it is a forest of stars.
No step gathers a component: a group is only ever reduced to its minimum (a
partial aggregate on the map side), so one component may hold a third of all
nodes.  Where a hub's edges meet its minimum, one side of the join has a row a
node, so adaptive execution splits the hub's partition.  The edge table is
checkpointed each round, so lost executors cost a round at most and the plan
stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node point at the least of it and its neighbours; repeats are left to ``_small_star``."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("nb")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("nb")))
    least = both.groupBy("n").agg(F.min("nb").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.where("nb > n").join(least, "n").select(F.col("nb").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point at the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that point at more than one, or point and are pointed at: none in a forest of stars."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst", max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node of an edge, component = smallest node.

    Edges are undirected; null ends, loops and repeats are ignored.  An empty
    edge table gives an empty result.  Raises if ``max_rounds`` do not suffice
    (rounds grow with the logarithm of the longest path, so this means a bug).
    """
    a, b = F.col(source), F.col(target)
    now = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        if _unsettled(now).isEmpty():
            break
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
