"""Questions of a lesson: which they are, their numbers, and their form for a learner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.choices import answer_label, choice_texts, with_items
from lectern.functions.text import bloom_bucket
from lectern.operators.numbering import number_within


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    order = [F.col("node_ord").asc_nulls_last(), F.col("question_id")]
    return number_within(rows, key, order, "ord").select(key, "question_id", F.upper(bloom_bucket(F.col("bloom_level"))).alias("bloom_level"), "ord")


def _of_objects(objects: DataFrame, questions: DataFrame) -> DataFrame:
    texts = objects.where(F.col("kind") == "text").select(F.col("id").alias("node_id"), "material_id", F.col("ord").alias("node_ord"))
    return questions.select(F.col("id").alias("question_id"), "node_id", "bloom_level").join(texts, "node_id")


def material_questions(objects: DataFrame, questions: DataFrame) -> DataFrame:
    """(material_id, question_id, bloom_level, ord), numbered from 1 by (order of the text object, question)."""
    return _numbered(_of_objects(objects, questions), "material_id")


def outline_questions(objects: DataFrame, questions: DataFrame, materials: DataFrame) -> DataFrame:
    """The same for an outline node, over its materials of any status; the material is no sort key."""
    m = materials.select(F.col("id").alias("material_id"), F.col("outline_node_id").alias("node"))
    rows = _of_objects(objects, questions).join(m, "material_id").withColumnRenamed("node", "outline_node_id")
    return _numbered(rows, "outline_node_id")


def fresh_questions(lessons: DataFrame, objects: DataFrame, questions: DataFrame, materials: DataFrame) -> DataFrame:
    """(lesson_id, question_id, bloom_level, ord) as a sync would number them now."""
    by_material = material_questions(objects, questions).withColumnRenamed("material_id", "source_id")
    by_node = outline_questions(objects, questions, materials).withColumnRenamed("outline_node_id", "source_id")
    rows = by_material.withColumn("source_kind", F.lit("material")).unionByName(by_node.withColumn("source_kind", F.lit("outline")))
    return rows.join(lessons.select(F.col("id").alias("lesson_id"), "source_kind", "source_id"), ["source_kind", "source_id"]).select(
        "lesson_id", "question_id", "bloom_level", "ord"
    )


def question_cards(module_questions: DataFrame, questions: DataFrame) -> DataFrame:
    """(lesson_id, id, ord, bucket, question, choices, correct_answer) of each stored question, stale ones included."""
    q = with_items(questions).select(
        F.col("id").alias("question_id"),
        F.col("question_text").alias("question"),
        choice_texts(F.col("choices"), F.col("question_format"), F.col("_parsed")).alias("choices"),
        answer_label(F.col("correct_answer"), F.col("choices"), F.col("question_format"), F.col("_parsed")).alias("correct_answer"),
    )
    stored = module_questions.where(F.col("bloom_level").isNotNull()).select(
        "lesson_id", "question_id", F.col("id").alias("link_id"), "ord", F.lower("bloom_level").alias("bucket")
    )
    return stored.join(q, "question_id")
