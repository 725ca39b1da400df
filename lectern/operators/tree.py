"""Depth, subtree size and pre-order of a forest by pointer doubling: as many rounds as the depth has binary digits, no limit of levels.

Each node points to its parent, a root to itself. A round makes each pointer jump to where its target points, so after k
rounds it leads 2**k levels up, or to the root. Each round is written; nodes that have reached their root sit out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.numbering import HOT_ROWS, running_sum
from lectern.sources.shared import saved


def _pointers(outline: DataFrame, *more) -> DataFrame:
    is_root = F.col("parent_id").isNull()
    return outline.select("id", F.coalesce("parent_id", "id").alias("up"), F.when(is_root, 0).otherwise(1).cast("bigint").alias("hops"), *more)


def measured(spark: SparkSession, outline: DataFrame, sizes: bool = False) -> DataFrame:
    """(root_id, id, depth[, size]) of every node that a root reaches; a root has depth 0, and size counts the node itself.

    Nodes on a cycle or below one, and those whose chain of parents ends in an id that is no node, are left out:
    no root reaches them. (A cycle shows when pointers have jumped farther than there are nodes.)
    """
    step, far = saved(_pointers(outline, F.lit(1).cast("bigint").alias("size")), "pointers"), 1
    n, left = step.agg(F.count(F.lit(1)), F.sum("hops")).first()
    while left and far <= n:
        going = step.where(F.col("hops") == far)
        target = step.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"))
        moved = going.join(target, "up").select("id", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), "size")
        there = step.where(F.col("hops") < far)
        after = there.select("id", "up", "hops", "size").unionByName(moved)
        if sizes:
            # Descendants at distances from `far` on below twice that are those of the nodes at distance `far`.
            more = going.groupBy("up").agg(F.sum("size").alias("_more")).withColumnRenamed("up", "id")
            after = after.join(more, "id", "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0))).drop("_more")
        step, far = saved(after, "pointers"), 2 * far
        left = step.where(F.col("hops") == far).count()
    ends = outline.where(F.col("parent_id").isNull()).select(F.col("id").alias("root_id"))
    found = step.where(F.col("hops") < far).select(F.col("up").alias("root_id"), "id", F.col("hops").alias("depth"), *(["size"] if sizes else []))
    return found.join(ends, "root_id", "left_semi")


def unreached(spark: SparkSession, outline: DataFrame) -> DataFrame:
    """(id, parent_id) of nodes that no root reaches: on or below a cycle, or below an id that is no node."""
    return outline.select("id", "parent_id").join(measured(spark, outline).select("id"), "id", "left_anti")


def preorder(spark: SparkSession, outline: DataFrame, most: int = HOT_ROWS) -> DataFrame:
    """(root_id, id, depth, position) of each node below a root: its 1-based place in the depth-first walk, children by (ord, id), nulls last.

    A node comes 1 + the sizes of the siblings before it after its parent; these steps are summed along the way to the root.
    Siblings are summed by range where a node has more than `most` children.
    """
    nodes = saved(measured(spark, outline, sizes=True).join(outline.select("id", "parent_id", "ord"), "id"), "measured")
    order = [F.col("ord").asc_nulls_last(), F.col("id")]
    below = running_sum(nodes.where("depth > 0"), "parent_id", order, F.col("size"), "_upto", most)
    steps = below.select("id", F.col("parent_id").alias("up"), (F.col("_upto") - F.col("size") + 1).alias("way"))
    tops = nodes.where("depth = 0").select("id", F.col("id").alias("up"), F.lit(0).cast("bigint").alias("way"))
    step, far = saved(steps.unionByName(tops), "ways"), 1
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    depth = nodes.select("id", "depth", "root_id")
    while far < deepest:
        there = step.alias("v").join(depth, "id")
        target = step.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("way").alias("_way"))
        moved = there.where(F.col("depth") > far).join(target, "up").select("id", F.col("_up").alias("up"), (F.col("way") + F.col("_way")).alias("way"))
        step, far = saved(there.where(F.col("depth") <= far).select("id", "up", "way").unionByName(moved), "ways"), 2 * far
    return step.join(depth, "id").where("depth > 0").select("root_id", "id", F.col("depth").cast("int").alias("depth"), F.col("way").alias("position"))
