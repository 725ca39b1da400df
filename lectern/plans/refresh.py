"""Packages after a change, at the cost of what changed.

The difference of two versions of the tables is carried through the joins of a package to the lessons whose package can differ. Only
these are assembled anew, from the rows that concern them; all other packages stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.package import packages
from lectern.sources.shared import saved

#: Kinds of columns whose values are hashed as they are, nulls told apart; others, which may hold nulls inside, go by their JSON.
PLAIN = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class Inputs:
    """One version of what `packages` takes."""

    lessons: DataFrame  # id, module_id, source_kind, source_id, title
    modules: DataFrame  # id, title, sequence_order
    outline: DataFrame
    materials: DataFrame
    objects: DataFrame
    questions: DataFrame
    links: DataFrame  # id, lesson_id, question_id, bloom_level, ord
    variants: DataFrame  # id, lesson_id, variant, narration, audio_url

    def packages(self) -> DataFrame:
        return packages(*[getattr(self, f.name) for f in fields(self)])


def differing(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, of new and old rows alike, all other columns) rows of keys whose rows are not the same in both versions.

    Rows are compared by 128 bits of hash, so only keys and hashes are shuffled, then the rows that differ.
    """
    if old is new:
        return old.where("false")
    columns = old.columns
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c) if isinstance(old.schema[c].dataType, PLAIN) else F.to_json(F.struct(c)))]  # a hash passes over nulls
    hashed = lambda df, n: df.select(F.col(key).alias("_key"), *[F.xxhash64(F.lit(seed), *parts).alias(f"_h{seed}") for seed in (1, 2)], F.lit(n).alias("_n"))
    both = hashed(old, -1).unionByName(hashed(new, 1)).groupBy("_key", "_h1", "_h2").agg(F.sum("_n").alias("_n"))
    keys = both.where("_n <> 0").select("_key").distinct()
    rows = old.select(*columns).unionByName(new.select(*columns))
    return rows.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def affected(before: Inputs, after: Inputs) -> DataFrame:
    """(lesson_id) of each lesson whose package may differ: a lesson of either version that a changed row reaches through the package's joins,
    in the old or in the new version."""
    changed = {f.name: differing(getattr(before, f.name), getattr(after, f.name)) for f in fields(Inputs)}
    both = lambda name: getattr(before, name).unionByName(getattr(after, name)) if getattr(before, name) is not getattr(after, name) else getattr(after, name)
    lessons = both("lessons").select(F.col("id").alias("lesson_id"), "module_id", "source_kind", "source_id").distinct()

    def sources(kind: str, ids: DataFrame) -> DataFrame:
        own = ids.select(F.col(ids.columns[0]).alias("source_id")).distinct()
        return lessons.where(F.col("source_kind") == kind).join(own, "source_id", "left_semi").select("lesson_id")

    of_objects = changed["objects"].where("kind = 'text'").select("material_id").distinct()
    nodes = both("materials").join(of_objects.withColumnRenamed("material_id", "id"), "id", "left_semi").select("outline_node_id")
    asked = both("links").join(changed["questions"].select(F.col("id").alias("question_id")).distinct(), "question_id", "left_semi")
    reached = [
        changed["lessons"].select(F.col("id").alias("lesson_id")),
        lessons.join(changed["modules"].select(F.col("id").alias("module_id")), "module_id", "left_semi").select("lesson_id"),
        sources("outline", changed["outline"].select("id")),
        sources("outline", changed["materials"].select("outline_node_id")),
        sources("outline", nodes),
        sources("material", of_objects),
        asked.select("lesson_id"),
        changed["links"].select("lesson_id"),
        changed["variants"].select("lesson_id"),
    ]
    return reduce(DataFrame.unionByName, reached).where("lesson_id is not null").distinct()


def narrowed(inputs: Inputs, lesson_ids: DataFrame) -> Inputs:
    """The rows that the packages of these lessons are made of."""
    of = lambda df, column, keys: df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi").select(*df.columns)
    lessons = of(inputs.lessons, "id", lesson_ids)
    nodes = lessons.where("source_kind = 'outline'").select("source_id")
    materials = of(inputs.materials, "outline_node_id", nodes)
    wanted = lessons.where("source_kind = 'material'").select("source_id").unionByName(materials.select(F.col("id").alias("source_id")))
    links = of(inputs.links, "lesson_id", lesson_ids)
    return replace(
        inputs,
        lessons=lessons,
        materials=materials,
        objects=of(inputs.objects, "material_id", wanted),
        questions=of(inputs.questions, "id", links.select("question_id")),
        links=links,
        variants=of(inputs.variants, "lesson_id", lesson_ids),
    )


def refreshed(old_packages: DataFrame, before: Inputs, after: Inputs) -> DataFrame:
    """The packages of `after`, given those of `before`: old ones of lessons that no change reaches, and fresh ones of the others."""
    reach = saved(affected(before, after), "affected")
    kept = old_packages.join(reach.withColumnRenamed("lesson_id", "_id"), F.col("lesson_node.id") == F.col("_id"), "left_anti")
    return kept.unionByName(narrowed(after, reach).packages())
