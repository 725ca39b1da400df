"""Ordered lesson text: one string per source, pieces separated by a blank line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import first_filled, text_piece
from lectern.operators.numbering import dealt_by_range, split_hot


#: Pieces of one text from which on they are joined in several tasks first.
HOT_PIECES = 100_000


def _joined(pieces: DataFrame, key: str, order: list[str], most: int = HOT_PIECES) -> DataFrame:
    """(key, lesson_text): a group's non-empty pieces in order, nulls last.

    A text of more than `most` pieces is made in two steps: its pieces are dealt by range of their order and joined in each
    range, then the ranges' texts, which are few, are joined. So no task holds all pieces of a long text as rows.
    """
    rank = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))), F.col("piece"))
    in_order: Column = F.array_sort(F.collect_list(F.when(F.col("piece") != "", rank)))
    text = F.concat_ws("\n\n", F.transform(in_order, lambda p: p["piece"])).alias("lesson_text")
    few, many = split_hot(pieces, key, most)
    plain = few.groupBy(key).agg(text)
    if many is None:
        return plain
    ranges = dealt_by_range(many, key, [F.col(c).asc_nulls_last() for c in order]).groupBy(key, "_part").agg(text)
    some = F.array_sort(F.collect_list(F.when(F.col("lesson_text") != "", F.struct("_part", "lesson_text"))))
    return plain.unionByName(ranges.groupBy(key).agg(F.concat_ws("\n\n", F.transform(some, lambda r: r["lesson_text"])).alias("lesson_text")))


def _text_objects(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("kind") == "text").select(
        F.col("id").alias("object_id"), "material_id", "ord", text_piece(F.col("title"), F.col("content")).alias("piece")
    )


def material_text(objects: DataFrame) -> DataFrame:
    """(material_id, lesson_text) of each material with a text object, whatever its status."""
    return _joined(_text_objects(objects), "material_id", ["ord", "object_id"])


def outline_text(objects: DataFrame, materials: DataFrame) -> DataFrame:
    """(node_id, lesson_text) over the completed materials attached to an outline node."""
    m = materials.where(F.col("status") == "completed").select(F.col("id").alias("material_id"), F.col("outline_node_id").alias("node_id"))
    return _joined(_text_objects(objects).join(m, "material_id"), "node_id", ["material_id", "ord", "object_id"])


def lesson_texts(lessons: DataFrame, objects: DataFrame, materials: DataFrame, outline: DataFrame) -> DataFrame:
    """(lesson_id, lesson_text): the source's text, else its description, else the lesson's title."""
    of_material = material_text(objects).select(F.lit("material").alias("source_kind"), F.col("material_id").alias("source_id"), "lesson_text")
    of_node = outline_text(objects, materials).select(F.lit("outline").alias("source_kind"), F.col("node_id").alias("source_id"), "lesson_text")
    described = outline.select(F.lit("outline").alias("source_kind"), F.col("id").alias("source_id"), "description")
    key = ["source_kind", "source_id"]
    return (
        lessons.join(of_material.unionByName(of_node), key, "left")
        .join(described, key, "left")
        .select(F.col("id").alias("lesson_id"), first_filled(F.col("lesson_text"), F.col("description"), F.col("title")).alias("lesson_text"))
    )
