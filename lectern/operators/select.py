"""First lesson of a course: chained top-1 selections on the synced state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.lookup import with_keys
from lectern.operators.sync import active_modules


def first_approved_course(courses: DataFrame) -> DataFrame:
    return courses.where("is_approved").orderBy("id").limit(1)


def first_active_modules(modules: DataFrame, outline: DataFrame) -> DataFrame:
    """One row per course: its first active module by (source order, source id). The least row combines before the shuffle."""
    active = active_modules(modules, outline)
    order = F.struct(F.col("source_ord").isNull(), "source_ord", "source_id")
    least = active.groupBy("course_id").agg(F.min_by(F.struct(*[c for c in active.columns if c != "course_id"]), order).alias("_row"))
    return least.select(*[F.col(c) if c == "course_id" else F.col(f"_row.{c}").alias(c) for c in active.columns])


def first_lesson(courses: DataFrame, modules: DataFrame, lessons: DataFrame, outline: DataFrame, course_id: int | None = None) -> DataFrame:
    """The lesson to begin with, or no row.

    Without course_id the first approved course counts; a given one needs no approval. Only the
    first module is tried. Sources without an order (materials have none) come last, then the lowest id.
    """
    course = first_approved_course(courses).select(F.col("id").alias("course_id")) if course_id is None else courses.where(F.col("id") == course_id).select(F.col("id").alias("course_id"))
    module = first_active_modules(modules, outline).join(course, "course_id", "left_semi").select(F.col("id").alias("module_id"), "course_id")
    if course_id is not None:  # lessons are those of one module, so only their nodes are looked up
        outline = with_keys(outline, "id", lessons.where(F.col("source_kind") == "outline").select("source_id"))
    order = outline.select(F.lit("outline").alias("source_kind"), F.col("id").alias("source_id"), F.col("ord").alias("source_ord"))
    return (
        lessons.join(module, "module_id")
        .join(order, ["source_kind", "source_id"], "left")
        .orderBy(F.col("source_ord").asc_nulls_last(), F.col("id"))
        .limit(1)
        .select("course_id", "module_id", F.col("id").alias("lesson_id"), "source_kind", "source_id")
    )
