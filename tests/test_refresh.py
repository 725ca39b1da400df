"""Packages after a change: those that it reaches anew, all others as they were, together as a full rebuild."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lectern.plans import refresh

from .test_course import LESSON, LINK, MATERIAL, OBJECT, OUTLINE, QUESTION, T0


def inputs(spark):
    outline = [(k, None, 1, k, f"N{k}", f"about {k}") for k in range(1, 9)]
    materials = [(10 + k, None, k % 4 + 1, "completed" if k % 3 else "pending", T0) for k in range(8)]
    objects = [(100 + k, 10 + k % 8, "text" if k % 5 else "image", f"T{k}", f"words {k}", k % 3) for k in range(40)]
    questions = [(200 + k, 100 + k % 40, "remember", "MCQ", f"q{k}", '["x","y"]', "y") for k in range(60)]
    lessons = [(k, 1 + k % 2, "material", 10 + k, f"Lesson {k}") for k in range(8)] + [(20 + k, 1 + k % 2, "outline", k, f"Lesson {20 + k}") for k in range(1, 7)]
    links = [(k, k % 8 if k % 3 else 21, 200 + k, "REMEMBER", k) for k in range(60)]
    modules = spark.createDataFrame([(1, "M1", 1), (2, "M2", 2)], "id bigint, title string, sequence_order int")
    variants = spark.createDataFrame([(1, 3, "Elaborated", "n", "u"), (2, 22, "normal", "m", "")], "id bigint, lesson_id bigint, variant string, narration string, audio_url string")
    made = [spark.createDataFrame(rows, schema) for rows, schema in ((lessons, LESSON), (outline, OUTLINE), (materials, MATERIAL), (objects, OBJECT), (questions, QUESTION), (links, LINK))]
    return refresh.Inputs(made[0], modules, *made[1:], variants)


def put(df, where, **values):
    return df.select(*[F.when(F.expr(where), F.expr(values[c])).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])


CHANGES = {
    "a text": ({"objects": lambda d: put(d, "id = 101", content="'new'")}, {1, 22}),
    "an image": ({"objects": lambda d: put(d, "id = 100", content="'new'")}, set()),
    "an object of another material": ({"objects": lambda d: put(d, "id = 101", material_id="12")}, {1, 2, 22, 23}),
    "a material of another node": ({"materials": lambda d: put(d, "id = 11", outline_node_id="5")}, {22, 25}),
    "a node": ({"outline": lambda d: put(d, "id = 6", description="'new'")}, {26}),
    "a module": ({"modules": lambda d: put(d, "id = 2", title="'new'")}, {1, 3, 5, 7, 21, 23, 25}),
    "a question": ({"questions": lambda d: put(d, "id = 201", question_text="'new'")}, {1}),
    "a link that goes": ({"links": lambda d: d.where("id <> 2")}, {2}),
    "a variant": ({"variants": lambda d: put(d, "id = 1", lesson_id="4")}, {3, 4}),
    "a lesson that comes": ({"lessons": lambda d: d.union(d.where("id = 7").withColumn("id", F.lit(70).cast("bigint")))}, {70}),
    "a lesson that goes": ({"lessons": lambda d: d.where("id <> 5")}, {5}),
    "nothing": ({"objects": lambda d: d.repartition(2)}, set()),
}


TOGETHER = [
    ["a text", "a node", "a variant"],
    ["an image"],
    ["an object of another material", "a module", "a lesson that goes"],
    ["a material of another node", "a question", "a link that goes", "a lesson that comes"],
    ["nothing"],
]


@pytest.mark.parametrize("names", TOGETHER, ids="; ".join)
def test_refresh_equals_a_rebuild(spark, names):
    before = after = inputs(spark)
    for table, change in [c for name in names for c in CHANGES[name][0].items()]:
        after = replace(after, **{table: change(getattr(after, table))})
    rows = lambda df: sorted(r.document for r in df.select(F.to_json(F.struct("*")).alias("document")).collect())
    assert {r.lesson_id for r in refresh.affected(before, after).collect()} == set().union(*[CHANGES[name][1] for name in names])
    assert rows(refresh.refreshed(before.packages(), before, after)) == rows(after.packages())


def test_differences_of_one_kind_each(spark):
    rows = [(1, None, "a", "2024-01-01 00:00:00.000001", [None, 1]), (2, "a", None, "2024-01-01 00:00:00", [1]), (3, "x", "y", None, None)]
    made = lambda rows: spark.createDataFrame(rows, "id bigint, a string, b string, at string, n array<int>").withColumn("at", F.col("at").cast("timestamp_ntz"))
    news = [
        [("a", None), (1, {})], [(None, "a"), (2, {})], [(None, "a"), (1, {"at": "2024-01-01 00:00:00.000002"})], [(None, "a"), (1, {"n": [1, None]})], [("x", "y"), (3, {"n": []})],
    ]
    for (a, b), (at, more) in news:
        new = [r if r[0] != at else (at, a, b, more.get("at", r[3]), more.get("n", r[4])) for r in rows]
        assert {r.id for r in refresh.differing(made(rows), made(new)).collect()} == {at}
    assert refresh.differing(made(rows), made(rows[::-1])).isEmpty()
