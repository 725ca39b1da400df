"""Connected components by contraction, in DataFrames alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import saved


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); component is the group's least node.

    In each round every node goes to the one of its neighbours, or itself, that comes first in a random
    order of the round, and edges are drawn between where their ends went. Edges within a group vanish,
    so each round is smaller than the last and their number grows with the logarithm of a group's
    diameter. Each round is a written table; nothing but whether edges are left reaches the driver.
    Edges may repeat, or join a node to itself; no edges give no rows.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    left = saved(_drawn(edges, F.col("a"), F.col("b")), "edges")
    steps: list[DataFrame] = []
    while left.head(1):
        rank = lambda c, k=len(steps): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("rank"), F.col(c).alias("node"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("first"))
        step = saved(near.select(F.col("a").alias("node"), F.least(rank("a"), "first")["node"].alias("to")), "step")
        steps.append(step)
        ends = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        left = saved(_drawn(ends, F.col("ta"), F.col("tb")), "edges")
    went = None
    for step in reversed(steps):
        if went is not None:
            step = step.join(went.select(F.col("node").alias("to"), F.col("to").alias("on")), "to", "left").select("node", F.coalesce("on", "to").alias("to"))
        went = step
    if went is None:
        return nodes.select("node", F.col("node").alias("component"))
    placed = saved(nodes.join(went, "node", "left").select("node", F.coalesce("to", "node").alias("to")), "placed")
    least = placed.groupBy("to").agg(F.min("node").alias("component"))
    return placed.join(least, "to").select("node", "component")


def _drawn(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Distinct edges between different nodes, the lesser first."""
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
