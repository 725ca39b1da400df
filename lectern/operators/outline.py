"""The outline tree and the cascade that finds a module's lesson sources.

One pass serves all roots, or those of one course; nothing is looked up node by node.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import tree
from lectern.operators.lookup import with_keys
from lectern.sources.shared import saved

#: Levels below given roots that are walked one by one; a deeper tree is walked by doubling.
LEVELS = 64


def roots(outline: DataFrame) -> DataFrame:
    return outline.where(F.col("parent_id").isNull())


def descendants(spark: SparkSession, outline: DataFrame) -> DataFrame:
    """(root_id, id, depth) of each node below a root, at any depth; the root itself is not among them. Found by doubling, in few rounds."""
    return tree.measured(spark, outline).where("depth > 0").select("root_id", "id", F.col("depth").cast("int").alias("depth"))


def below(spark: SparkSession, outline: DataFrame, seeds: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(root_id, id) of each node below the given roots, whatever its other columns are.

    The walk begins at the given roots and follows their children only, level by level; where these are more than `levels`,
    all nodes find their root by doubling instead. The tree may have any number of rows: the recursion's row limit is lifted while it runs,
    and levels are joined by shuffles, as a broadcast would send the whole outline through the driver once a level.
    """
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        walk = spark.sql(
            f"""
            with recursive below(root_id, id) max recursion level {levels} as (
              select /*+ merge(c) */ r.id, c.id from {{seeds}} r join {{outline}} c on c.parent_id = r.id
              union all
              select /*+ merge(c) */ b.root_id, c.id from below b join {{outline}} c on c.parent_id = b.id
            )
            select * from below
            """,
            outline=outline.select("id", "parent_id"),
            seeds=seeds.select("id"),
        )
        return saved(walk, "below")  # as the recursion would run anew wherever its rows are asked for
    except (PySparkException, Py4JJavaError) as e:
        if "RECURSION_LEVEL_LIMIT_EXCEEDED" not in str(e):
            raise
        own = seeds.select(F.col("id").alias("root_id"))
        return descendants(spark, outline).select("root_id", "id").join(own, "root_id", "left_semi")
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def preorder(spark: SparkSession, outline: DataFrame) -> DataFrame:
    """(root_id, id, depth, position): position is the 1-based place in the depth-first walk below its root."""
    return tree.preorder(spark, outline)


def completed(materials: DataFrame) -> DataFrame:
    return materials.where(F.col("status") == "completed")


def direct_sources(outline: DataFrame, materials: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """First tier: completed materials that name the root as their module; of all roots, or of those given."""
    m = completed(materials).select(F.col("module_node_id").alias("root_id"), F.col("id").alias("source_id"), "created_at")
    if seeds is not None:
        return with_keys(m, "root_id", seeds.select("id"))
    return m.join(roots(outline).select(F.col("id").alias("root_id")), "root_id", "left_semi").select("root_id", "source_id", "created_at")


def inherited_sources(spark: SparkSession, outline: DataFrame, materials: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Second tier: completed materials with no module, attached to a node below the root."""
    m = completed(materials).where(F.col("module_node_id").isNull()).select(
        F.col("outline_node_id").alias("node_id"), F.col("id").alias("source_id"), "created_at"
    )
    nodes = (descendants(spark, outline) if seeds is None else below(spark, outline, seeds)).select("root_id", F.col("id").alias("node_id"))
    if seeds is not None:  # of a walk's nodes, those that bear material meet it: a small side as a rule, found by a shuffle
        nodes = nodes.join(m.select("node_id").distinct().hint("merge"), "node_id", "left_semi")
    return m.join(nodes, "node_id").select("root_id", "source_id", "created_at")


def lesson_sources(spark: SparkSession, outline: DataFrame, materials: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(root_id, tier, source_kind, source_id, created_at): of each root, or each of those given, the first tier that has any source.

    The third tier is the root itself. The lowest tier of a root is an aggregate that
    combines before the shuffle, so a root with very many materials stays spread out.
    """
    tops = roots(outline) if seeds is None else seeds
    tiers = [
        direct_sources(outline, materials, seeds).withColumns({"tier": F.lit(1), "source_kind": F.lit("material")}),
        inherited_sources(spark, outline, materials, seeds).withColumns({"tier": F.lit(2), "source_kind": F.lit("material")}),
        tops.select(F.col("id").alias("root_id"), F.col("id").alias("source_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
        .withColumns({"tier": F.lit(3), "source_kind": F.lit("outline")}),
    ]
    rows = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    best = rows.groupBy("root_id").agg(F.min("tier").alias("tier"))
    return rows.join(best, ["root_id", "tier"], "left_semi").select("root_id", "tier", "source_kind", "source_id", "created_at")
