"""The nested document of a lesson: module, lesson, three variants, questions by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import BLOOM_BUCKETS, VARIANT_KEYS, node_order
from lectern.operators.lesson_text import lesson_texts
from lectern.operators.questions import question_cards
from lectern.operators.variants import variant_spine

_CARD = "struct<id:bigint,`order`:bigint,bloom_level:string,question:string,choices:array<string>,correct_answer:string>"


def variant_maps(spine: DataFrame) -> DataFrame:
    """(lesson_id, variants): a map with the three keys in their fixed order."""
    place = F.array_position(F.array(*map(F.lit, VARIANT_KEYS)), F.col("variant"))
    entry = F.struct(place.alias("place"), F.col("variant").alias("key"), F.struct("text", "audio_url").alias("value"))
    entries = F.array_sort(F.collect_list(entry))
    return spine.groupBy("lesson_id").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"]))).alias("variants"))


def question_maps(cards: DataFrame) -> DataFrame:
    """(lesson_id, questions): the three buckets in order, then any other stored level; each list by (order, link id)."""
    card = F.struct(
        F.col("question_id").alias("id"), F.col("ord").alias("order"), F.col("bucket").alias("bloom_level"), "question", "choices", "correct_answer"
    )
    ranked = F.array_sort(F.collect_list(F.struct(F.col("ord").isNull().alias("no_ord"), "ord", "link_id", card.alias("card"))))
    lists = cards.groupBy("lesson_id", "bucket").agg(F.transform(ranked, lambda r: r["card"]).cast(f"array<{_CARD}>").alias("list"))
    found = lists.groupBy("lesson_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "list")), lambda a, b: F.when(a["bucket"] < b["bucket"], -1).when(a["bucket"] > b["bucket"], 1).otherwise(0))).alias("found"))
    return found.select("lesson_id", _with_all_buckets(F.col("found")).alias("questions"))


def _seed():
    return F.map_from_arrays(F.array(*map(F.lit, BLOOM_BUCKETS)), F.array_repeat(F.array().cast(f"array<{_CARD}>"), len(BLOOM_BUCKETS)))


def _with_all_buckets(found):
    """found extended by empty lists: the three buckets in order, then other levels by name."""
    buckets = F.array(*map(F.lit, BLOOM_BUCKETS))
    empty = F.filter(F.map_entries(_seed()), lambda e: ~F.map_contains_key(found, e["key"]))
    place = lambda key: F.coalesce(F.nullif(F.array_position(buckets, key), F.lit(0)), F.lit(len(BLOOM_BUCKETS) + 1))
    ranked = F.transform(F.concat(F.map_entries(found), empty), lambda e: F.struct(place(e["key"]).alias("place"), e["key"], e["value"]))
    return F.map_from_entries(F.transform(F.array_sort(ranked), lambda e: F.struct(e["key"], e["value"])))


def packages(
    lessons: DataFrame,
    modules: DataFrame,
    outline: DataFrame,
    materials: DataFrame,
    objects: DataFrame,
    questions: DataFrame,
    module_questions: DataFrame,
    variants: DataFrame,
) -> DataFrame:
    """One nested package per lesson, for all lessons at once; filter by `lesson_node.id` for one.

    lessons: id, module_id, source_kind, source_id, title; modules: id, title, sequence_order;
    module_questions is the state after a sync, so stale rows show up too.
    """
    texts = lesson_texts(lessons, objects, materials, outline)
    header = package_headers(lessons, modules, outline)
    return (
        header.join(variant_maps(variant_spine(texts, variants)), "lesson_id")
        .join(question_maps(question_cards(module_questions, questions)), "lesson_id", "left")
        .select(
            F.struct(F.col("module_id").alias("id"), F.col("module_title").alias("title"), "sequence_order").alias("module"),
            F.struct(F.col("lesson_id").alias("id"), F.col("lesson_title").alias("title"), "node_order").alias("lesson_node"),
            "variants",
            F.coalesce("questions", _seed()).alias("questions"),
        )
    )


def package_headers(lessons: DataFrame, modules: DataFrame, outline: DataFrame) -> DataFrame:
    """(lesson_id, lesson_title, node_order, module_id, module_title, sequence_order)."""
    order = outline.select(F.lit("outline").alias("source_kind"), F.col("id").alias("source_id"), F.col("ord").alias("source_ord"))
    module = modules.select(F.col("id").alias("module_id"), F.col("title").alias("module_title"), "sequence_order")
    return (
        lessons.join(module, "module_id")
        .join(order, ["source_kind", "source_id"], "left")
        .select(
            F.col("id").alias("lesson_id"),
            F.col("title").alias("lesson_title"),
            node_order(F.col("source_ord"), F.col("id")).alias("node_order"),
            "module_id",
            "module_title",
            "sequence_order",
        )
    )


def without_answers(package: DataFrame) -> DataFrame:
    """The learner's view of a package: id, title, variants, and questions without answer, order and level; empty buckets go."""
    shown = F.transform_values("questions", lambda k, cards: F.transform(cards, lambda c: F.struct(c["id"], c["question"], c["choices"])))
    return package.select(
        F.col("module"),
        F.col("lesson_node.id").alias("id"),
        F.col("lesson_node.title").alias("title"),
        "variants",
        F.map_filter(shown, lambda k, cards: F.size(cards) > 0).alias("questions"),
    )


def module_view(shown: DataFrame) -> DataFrame:
    """(id, sequence_order, title, lesson_nodes) of each module, its lessons by id."""
    lesson = F.struct("id", "title", "variants", "questions")
    listed = F.array_sort(F.collect_list(lesson), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return shown.groupBy("module").agg(listed.alias("lesson_nodes")).select("module.id", "module.sequence_order", "module.title", "lesson_nodes")


def as_json(package: DataFrame) -> DataFrame:
    """(lesson_id, document): a package as the JSON text that a client gets, keys in their fixed order."""
    return package.select(F.col("lesson_node.id").alias("lesson_id"), F.to_json(F.struct("module", "lesson_node", "variants", "questions"), {"ignoreNullFields": "false"}).alias("document"))
