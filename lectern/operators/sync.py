"""Snapshot merges: (old state, fresh rows) -> new state, as pure functions.

Nothing is ever deleted or switched off by a merge. New ids continue after the
highest old id, in insertion order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.numbering import number_rows
from lectern.operators.outline import lesson_sources, roots
from lectern.sources.shared import saved


def _last(order: Column) -> Column:
    """A sort key that puts nulls last."""
    return F.coalesce(order.cast("bigint"), F.lit(2**62))


def _after(old: DataFrame) -> DataFrame:
    return old.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("_top"))


def sync_modules(old: DataFrame, outline: DataFrame) -> DataFrame:
    """(id, source_id, is_active): a module for each root. Known modules of a root become active again,
    modules whose source is no root any more stay as they are."""
    wanted = roots(outline).select(F.col("id").alias("source_id"), "ord")
    kept = (
        old.select("id", "source_id", "is_active")
        .join(wanted.select("source_id", F.lit(True).alias("_seen")), "source_id", "left")
        .select("id", "source_id", F.coalesce("_seen", "is_active").alias("is_active"))
    )
    fresh = wanted.join(old.select("source_id"), "source_id", "left_anti")
    numbered = number_rows(fresh, [_last(F.col("ord")), F.col("source_id")], "_n")
    new = numbered.crossJoin(F.broadcast(_after(old))).select((F.col("_top") + F.col("_n")).alias("id"), "source_id", F.lit(True).alias("is_active"))
    return kept.unionByName(new)


def sync_lessons(spark: SparkSession, old: DataFrame, modules: DataFrame, outline: DataFrame, materials: DataFrame) -> DataFrame:
    """(id, module_id, source_kind, source_id): a lesson for each source of each module; old ones stay."""
    sources = lesson_sources(spark, outline, materials)
    wanted = (
        sources.join(modules.select(F.col("id").alias("module_id"), F.col("source_id").alias("root_id")), "root_id")
        .join(outline.select(F.col("id").alias("root_id"), "ord"), "root_id")
        .select("module_id", "source_kind", "source_id", "created_at", "ord", "root_id")
    )
    keys = ["module_id", "source_kind", "source_id"]
    fresh = wanted.join(old.select(*keys), keys, "left_anti")
    order = [_last(F.col("ord")), F.col("root_id"), F.col("created_at").asc_nulls_last(), F.col("source_id").asc_nulls_last()]
    numbered = number_rows(fresh, order, "_n")
    new = numbered.crossJoin(F.broadcast(_after(old))).select((F.col("_top") + F.col("_n")).alias("id"), *keys)
    return old.select("id", *keys).unionByName(new)


def sync_questions(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, lesson_id, question_id, bloom_level, ord): upsert by (lesson, question).

    Fresh level and order win, rows that are no longer fresh stay with their old values.
    """
    keys = ["lesson_id", "question_id"]
    both = old.select("id", *keys, F.col("bloom_level").alias("_level"), F.col("ord").alias("_ord")).join(
        fresh.select(*keys, "bloom_level", "ord", F.lit(True).alias("_fresh")), keys, "full_outer"
    )
    value = lambda new, before: F.when(F.col("_fresh"), F.col(new)).otherwise(F.col(before)).alias(new)
    merged = saved(both.select("id", *keys, value("bloom_level", "_level"), value("ord", "_ord")), "merged")
    order = [F.col("lesson_id"), F.col("ord").asc_nulls_last(), F.col("question_id")]
    numbered = number_rows(merged.where(F.col("id").isNull()).drop("id"), order, "_n")
    new = numbered.crossJoin(F.broadcast(_after(old))).select((F.col("_top") + F.col("_n")).alias("id"), *keys, "bloom_level", "ord")
    return merged.where(F.col("id").isNotNull()).unionByName(new)


def module_changes(known: DataFrame, own_roots: DataFrame) -> DataFrame:
    """(id, source_id, is_active, ord): of the roots, modules that are new (null id) or become active again; `known` has the modules of these roots."""
    wanted = own_roots.select(F.col("id").alias("source_id"), "ord")
    return wanted.join(known.select("id", "source_id", "is_active"), "source_id", "left").where("id is null or not is_active").select("id", "source_id", F.lit(True).alias("is_active"), "ord")


def lesson_changes(known: DataFrame, modules: DataFrame, sources: DataFrame, own_roots: DataFrame) -> DataFrame:
    """(id, module_id, source_kind, source_id, and what orders them): lessons that the modules' sources lack, without id."""
    module = modules.select(F.col("id").alias("module_id"), F.col("source_id").alias("root_id"))
    wanted = sources.join(module, "root_id").join(own_roots.select(F.col("id").alias("root_id"), "ord"), "root_id")
    fresh = wanted.join(known.select("module_id", "source_kind", "source_id"), ["module_id", "source_kind", "source_id"], "left_anti")
    return fresh.select(F.lit(None).cast("bigint").alias("id"), "module_id", "source_kind", "source_id", "ord", "root_id", "created_at")


def question_changes(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, lesson_id, question_id, bloom_level, ord): fresh rows that are new (null id) or differ from what is known of them."""
    keys = ["lesson_id", "question_id"]
    old = known.select("id", *keys, F.col("bloom_level").alias("_level"), F.col("ord").alias("_ord"))
    both = fresh.select(*keys, "bloom_level", "ord").join(old, keys, "left")
    same = F.col("id").isNotNull() & F.col("bloom_level").eqNullSafe(F.col("_level")) & F.col("ord").eqNullSafe(F.col("_ord"))
    return both.where(~same).select("id", *keys, "bloom_level", "ord")


def active_modules(modules: DataFrame, outline: DataFrame, course_id: int | None = None) -> DataFrame:
    """Active modules with their course, of one course or of all."""
    out = modules.where("is_active").join(
        outline.select(F.col("id").alias("source_id"), "course_id", F.col("ord").alias("source_ord")), "source_id"
    )
    return out if course_id is None else out.where(F.col("course_id") == course_id)
