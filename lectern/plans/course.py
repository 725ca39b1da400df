"""The course calls a client makes: bring a course's outline up to date, choose its first lesson, build one lesson's package.

State lies in a snapshot folder: modules, lessons, module_questions, each by its key. A call reads what it is about, and
commits the rows that it changes as one version; several clients may call at once, and none loses what another did.
Calls work at the cost of what they are about: the keys of one course or lesson go to the scans of the tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lectern.operators import select, sync
from lectern.operators.lookup import by_key, with_keys
from lectern.operators.outline import lesson_sources, roots
from lectern.operators.questions import fresh_questions
from lectern.operators.snapshot import Delta, Keyed, Snapshot, commit, current, no_rows
from lectern.plans import package

MODULES = Keyed("modules", "id bigint, source_id bigint, is_active boolean", ("source_id",), "source_id")
LESSONS = Keyed("lessons", "id bigint, module_id bigint, source_kind string, source_id bigint", ("module_id", "source_kind", "source_id"), "module_id", fixed=True)
QUESTIONS = Keyed("module_questions", "id bigint, lesson_id bigint, question_id bigint, bloom_level string, ord bigint", ("lesson_id", "question_id"), "lesson_id")
MODULE_QUESTIONS = QUESTIONS.schema


@dataclass
class Course:
    """Tables that others write, and the folder of the state."""

    root: str
    courses: DataFrame  # id, title, is_approved
    outline: DataFrame  # id, parent_id, course_id, ord, title, description
    materials: DataFrame  # id, module_node_id, outline_node_id, status, created_at
    objects: DataFrame  # id, material_id, kind, title, content, ord
    questions: DataFrame  # id, node_id, bloom_level, question_text, choices, question_format, correct_answer
    variants: DataFrame  # id, lesson_id, variant, narration, audio_url


def titled(lessons: DataFrame) -> DataFrame:
    return lessons.withColumn("title", F.concat(F.lit("Lesson "), F.col("id").cast("string")))


def _outline_changes(store: Course, own: DataFrame, before: Snapshot) -> list[Delta]:
    """Modules of the roots `own` that are new or become active, and lessons that their sources lack; sources are found below the roots, whatever
    the course of a node there."""
    known = with_keys(before.rows(MODULES), "source_id", own.select(F.col("id").alias("source_id")))
    modules = before.delta(MODULES, sync.module_changes(known, own), ["ord", "source_id"])
    mine = known.join(modules.rows.select("source_id"), "source_id", "left_anti").unionByName(modules.rows)
    sources = lesson_sources(own.sparkSession, store.outline, store.materials, own)
    there = with_keys(before.rows(LESSONS), "module_id", mine.select(F.col("id").alias("module_id")))
    lessons = before.delta(LESSONS, sync.lesson_changes(there, mine, sources, own), ["ord", "root_id", "created_at", "source_id"])
    return [modules, lessons]


def sync_course_outline(spark: SparkSession, store: Course, course_id: int) -> DataFrame:
    """The active modules of one course after its outline is brought up to date; an unknown course raises.

    Modules of the course's roots and lessons of these modules are merged and committed together; those of other courses stay as they are.
    """
    by_key(store.courses, "id", course_id, strict=True).collect()
    own = roots(store.outline.where(F.col("course_id") == course_id))
    commit(spark, store.root, lambda before: _outline_changes(store, own, before))
    return active_modules(spark, store, course_id)


def active_modules(spark: SparkSession, store: Course, course_id: int) -> DataFrame:
    """Active modules of a course in the current state, also those whose source is no root any more."""
    return sync.active_modules(current(spark, store.root).rows(MODULES), store.outline, course_id)


def first_lesson_node(spark: SparkSession, store: Course, course_id: int | None = None) -> DataFrame:
    """The lesson to begin with, or no row: of a given course, or of the first approved one. Only that course is synced."""
    if course_id is None:
        first = select.first_approved_course(store.courses).first()
        if first is None:
            return no_rows(spark, "course_id bigint, module_id bigint, lesson_id bigint, source_kind string, source_id bigint")
        course_id = first.id
    sync_course_outline(spark, store, course_id)
    state = current(spark, store.root)
    outline = store.outline.where(F.col("course_id") == course_id)
    module = select.first_active_modules(state.rows(MODULES), outline).first()  # a row a course
    lessons = state.rows(LESSONS, only=module.id) if module else state.rows(LESSONS).where("false")
    return select.first_lesson(store.courses, state.rows(MODULES), lessons, store.outline, course_id)


def narrowed(store: Course, lesson: Row) -> Course:
    """The store as far as one lesson's source goes: its node, the node's materials, their objects, the objects' questions."""
    nodes = store.outline.where(F.col("id") == lesson.source_id) if lesson.source_kind == "outline" else store.outline.where("false")
    if lesson.source_kind == "material":
        materials = store.materials.where(F.col("id") == lesson.source_id)
        objects = store.objects.where(F.col("material_id") == lesson.source_id)
    else:
        materials = store.materials.where(F.col("outline_node_id") == lesson.source_id)
        objects = with_keys(store.objects, "material_id", materials.select(F.col("id").alias("material_id")))
    objects = objects.where(F.col("kind") == "text")
    questions = with_keys(store.questions, "node_id", objects.select(F.col("id").alias("node_id")))
    variants = store.variants.where(F.col("lesson_id") == lesson.id)
    return replace(store, outline=nodes, materials=materials, objects=objects, questions=questions, variants=variants)


def build_package(spark: SparkSession, store: Course, lesson_id: int) -> DataFrame:
    """The nested package of one lesson, one row; an unknown lesson raises. The lesson's questions are synced and committed before.

    Only rows of the lesson are read and written: what grows with other lessons is at most the files that scans pass over by their statistics.
    """
    lesson = by_key(current(spark, store.root).rows(LESSONS), "id", lesson_id, strict=True).first()
    own = narrowed(store, lesson)
    one = titled(spark.range(1).select(*[F.lit(lesson[c]).cast(kind).alias(c) for c, kind in (x.split() for x in LESSONS.schema.split(", "))]))

    def change(before: Snapshot) -> list[Delta]:
        fresh = fresh_questions(one, own.objects, own.questions, own.materials)
        return [before.delta(QUESTIONS, sync.question_changes(before.rows(QUESTIONS, only=lesson_id), fresh), ["ord", "question_id"])]

    commit(spark, store.root, change)
    state = current(spark, store.root)
    links = state.rows(QUESTIONS, only=lesson_id)
    nodes = store.outline.select(F.col("id").alias("source_id"), "title", F.col("ord").alias("sequence_order"))
    module = state.rows(MODULES, where=F.col("id") == lesson.module_id)
    modules = with_keys(nodes, "source_id", module.select("source_id")).join(module, "source_id")
    shown = with_keys(store.questions, "id", links.select(F.col("question_id").alias("id")))  # stale links have questions of other objects
    return package.packages(one, modules, own.outline, own.materials, own.objects, shown, links, own.variants)
