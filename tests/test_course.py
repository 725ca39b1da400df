"""Hand-written edge cases of the course operators."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions.choices import answer_label, choice_texts
from lectern.functions.text import bloom_bucket, node_order, strip
from lectern.operators import lesson_text, lookup, outline, questions, select, snapshot, sync, variants
from lectern.operators.numbering import number_rows
from lectern.plans import course, course_queries, package

OUTLINE = "id bigint, parent_id bigint, course_id bigint, ord int, title string, description string"
MATERIAL = "id bigint, module_node_id bigint, outline_node_id bigint, status string, created_at timestamp_ntz"
OBJECT = "id bigint, material_id bigint, kind string, title string, content string, ord bigint"
QUESTION = "id bigint, node_id bigint, bloom_level string, question_format string, question_text string, choices string, correct_answer string"
LESSON = "id bigint, module_id bigint, source_kind string, source_id bigint, title string"
MODULE = "id bigint, source_id bigint, is_active boolean"
LINK = "id bigint, lesson_id bigint, question_id bigint, bloom_level string, ord bigint"
T0 = dt.datetime(2024, 1, 1)

CHOICES = [
    ("MCQ", " b ", '["w","x"]', "B", ["w", "x"]),
    ("MCQ", "B", '["B","C"]', "B", ["B", "C"]),
    ("MCQ", "X", '["w"," x "]', "B", ["w", " x "]),
    ("MCQ", "e", '["a1","b1","c1","d1","e"]', "e", ["a1", "b1", "c1", "d1"]),
    ("MCQ", None, '{"A":"x","C":"y"}', "B", ["x", "y"]),
    ("MCQ", None, '["x",""]', "B", ["x", ""]),
    ("MCQ", None, None, "", []),
    ("TF", "TRUE", '["False","True"]', "A", ["False", "True"]),
    ("TF", "false", None, "B", ["True", "False"]),
    ("TF", "maybe", None, "maybe", ["True", "False"]),
    ("tf", "true", '["False","True"]', "B", ["False", "True"]),
    ("MCQ", "none", '{"A":null}', "A", []),
    ("MCQ", "y", '{"A":"","B":"y","C":" z "}', "B", ["y", " z "]),
    ("MCQ", "true", "[true,null,1,1.0]", "A", ["True", "None", "1", "1.0"]),
    ("MCQ", "zz", '{"a":"zz"}', "zz", []),
    ("TF", "", "{}", "", ["True", "False"]),
    ("MCQ", "q", '"pqrst"', "B", ["p", "q", "r", "s"]),
    ("MCQ", " Paris\t", '["paris"]', "A", ["paris"]),
    ("MCQ", " Rome ", '["paris"]', "Rome", ["paris"]),
    ("MCQ", "7", "7", "7", []),
    ("MCQ", "0", '{"A":0,"B":false,"C":[],"D":"d"}', "A", ["d"]),
]


def test_answer_label_and_choice_texts(spark):
    df = spark.createDataFrame([(i, *row[:3]) for i, row in enumerate(CHOICES)], "i int, f string, a string, c string")
    out = df.select("i", answer_label(F.col("a"), F.col("c"), F.col("f")).alias("label"), choice_texts(F.col("c"), F.col("f")).alias("texts")).orderBy("i").collect()
    assert [(r.label, r.texts) for r in out] == [row[3:] for row in CHOICES]


def test_bloom_bucket(spark):
    levels = [None, "", "REMEMBER", "Understand", " remember ", "apply", "analyze"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(levels)], "i int, x string")
    got = [r.b for r in df.orderBy("i").select(bloom_bucket(F.col("x")).alias("b")).collect()]
    assert got == ["analyze", "analyze", "remember", "understand", "analyze", "analyze", "analyze"]


def test_strip_looks_at_the_ends_only(spark):
    df = spark.range(1).select(F.concat(F.lit(" a"), F.repeat(F.lit(" "), 400_000), F.lit("b\n")).alias("x"))  # a search for blanks before the end would take their square
    began = time.monotonic()
    assert df.select(F.length(strip(F.col("x"))).alias("n")).distinct().first().n == 400_002
    assert time.monotonic() - began < 20


def test_strip_is_unicode(spark):
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0      　"
    df = spark.createDataFrame([(c + "a" + c,) for c in spaces + "​"], "x string")
    assert [r.y for r in df.select(strip(F.col("x")).alias("y")).collect()] == [(c + "a" + c).strip() for c in spaces + "​"]


def _outline(spark, rows):
    return spark.createDataFrame([(i, p, 1, o, f"t{i}", "") for i, p, o in rows], OUTLINE)


def test_preorder_and_cycle_free_roots(spark):
    df = _outline(spark, [(1, None, 1), (2, 1, 2), (3, 1, 1), (4, 3, 1), (5, 1, 1), (6, 2, None), (7, 2, 5), (8, 8, 1)])
    rows = outline.preorder(spark, df).orderBy("position").collect()
    assert [(r.id, r.depth) for r in rows] == [(3, 1), (4, 2), (5, 1), (2, 1), (7, 2), (6, 2)]


def test_cascade(spark):
    tree = _outline(spark, [(r, None, r) for r in range(1, 7)] + [(10, 1, 1), (20, 2, 1), (21, 20, 1), (30, 3, 1)])
    m = lambda i, module, node, status="completed": (i, module, node, status, T0)
    materials = spark.createDataFrame(
        [m(1, 1, 1), m(2, None, 10), m(3, None, 21), m(4, 2, 2, "pending"), m(5, 1000, 30), m(6, None, 4), m(8, 5, 5), m(7, 5, 5)], MATERIAL
    )
    rows = outline.lesson_sources(spark, tree, materials).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.root_id, r.source_id)):
        found.setdefault(r.root_id, []).append((r.source_kind, r.source_id))
    assert found == {
        1: [("material", 1)], 2: [("material", 3)], 3: [("outline", 3)], 4: [("outline", 4)], 5: [("material", 7), ("material", 8)], 6: [("outline", 6)],
    }


def test_ordered_text(spark):
    objects = spark.createDataFrame(
        [
            (1, 1, "text", "B", "b", 2), (2, 1, "text", "A", "a", 1), (3, 2, "text", "", "", 1), (4, 2, "text", "T", "c", 1),
            (5, 3, "image", "A", "a", 1), (6, 4, "text", None, "c", 1), (7, 5, "text", "", " ", 1),
        ],
        OBJECT,
    )
    got = {r.material_id: r.lesson_text for r in lesson_text.material_text(objects).collect()}
    assert got == {1: "A\na\n\nB\nb", 2: "T\nc", 4: "None\nc", 5: ""}
    pending = spark.createDataFrame([(1, None, 9, "pending", T0)], MATERIAL)
    assert lesson_text.outline_text(objects, pending).count() == 0
    asked = spark.createDataFrame([(1, 2, "remember", "MCQ", "q", None, None)], QUESTION)
    assert questions.outline_questions(objects, asked, pending).count() == 1


def test_sync_modules_and_lessons(spark):
    tree = _outline(spark, [(1, None, 2), (2, None, 1), (3, None, None)])
    old = spark.createDataFrame([(5, 1, False), (6, 77, True)], MODULE)
    first = sync.sync_modules(old, tree)
    assert {tuple(r) for r in first.select("id", "source_id", "is_active").collect()} == {(5, 1, True), (6, 77, True), (7, 2, True), (8, 3, True)}
    again = sync.sync_modules(first, tree)
    assert {tuple(r) for r in again.select("id", "source_id", "is_active").collect()} == {tuple(r) for r in first.select("id", "source_id", "is_active").collect()}

    none = spark.createDataFrame([], "id bigint, module_id bigint, source_kind string, source_id bigint")
    no_material, material = spark.createDataFrame([], MATERIAL), spark.createDataFrame([(40, 2, 2, "completed", T0)], MATERIAL)
    before = sync.sync_lessons(spark, none, first, tree, no_material)
    assert [(r.id, r.source_id) for r in before.orderBy("id").collect()] == [(1, 2), (2, 1), (3, 3)]
    after = sync.sync_lessons(spark, before, first, tree, material)
    assert {(r.id, r.source_kind, r.source_id) for r in after.collect()} == {(1, "outline", 2), (2, "outline", 1), (3, "outline", 3), (4, "material", 40)}


def test_sync_questions_keeps_stale_rows(spark):
    old = spark.createDataFrame([(1, 1, 10, "APPLY", 9), (2, 1, 11, "REMEMBER", 4)], LINK)
    fresh = spark.createDataFrame([(1, 10, "ANALYZE", 1), (1, 12, "REMEMBER", 2), (2, 10, "ANALYZE", 1)], "lesson_id bigint, question_id bigint, bloom_level string, ord bigint")
    want = {(1, 1, 10, "ANALYZE", 1), (2, 1, 11, "REMEMBER", 4), (3, 1, 12, "REMEMBER", 2), (4, 2, 10, "ANALYZE", 1)}
    columns = ["id", "lesson_id", "question_id", "bloom_level", "ord"]
    first = sync.sync_questions(old, fresh).select(*columns)
    assert {tuple(r) for r in first.collect()} == want
    assert {tuple(r) for r in sync.sync_questions(first, fresh).select(*columns).collect()} == want


def test_node_order_zero_is_missing(spark):
    df = spark.createDataFrame([(0, 42), (3, 42), (None, 7)], "o int, id bigint")
    assert [r.n for r in df.select(node_order(F.col("o"), F.col("id")).alias("n")).collect()] == [42, 3, 7]


@pytest.mark.parametrize("approved, course, want", [(True, None, 2), (False, None, None), (False, 1, 2)])
def test_first_lesson(spark, approved, course, want):
    tree = _outline(spark, [(1, None, 5), (2, None, 3)])
    modules = spark.createDataFrame([(1, 1, True), (2, 2, True)], MODULE)
    lessons = spark.createDataFrame([(3, 2, "material", 9, ""), (2, 2, "material", 8, ""), (1, 1, "material", 7, "")], LESSON)
    courses = spark.createDataFrame([(1, approved)], "id bigint, is_approved boolean")
    rows = select.first_lesson(courses, modules, lessons, tree, course).collect()
    assert [r.lesson_id for r in rows] == ([want] if want else [])


def test_first_module_without_lessons_ends_the_search(spark):
    tree = _outline(spark, [(1, None, 5), (2, None, 3)])
    modules = spark.createDataFrame([(1, 1, True), (2, 2, True)], MODULE)
    lessons = spark.createDataFrame([(1, 1, "material", 7, "")], LESSON)
    courses = spark.createDataFrame([(1, True)], "id bigint, is_approved boolean")
    assert select.first_lesson(courses, modules, lessons, tree).count() == 0


def test_variants(spark):
    texts = spark.createDataFrame([(1, "own")], "lesson_id bigint, lesson_text string")
    saved = spark.createDataFrame(
        [(1, 1, "SIMPLIFIED", "old", "u"), (2, 1, "simplified", "", "v"), (3, 1, "extra", "x", "w"), (4, 1, None, "y", "z")],
        "id bigint, lesson_id bigint, variant string, narration string, audio_url string",
    )
    rows = {r.variant: (r.text, r.audio_url) for r in variants.variant_spine(texts, saved).collect()}
    assert rows == {"normal": ("own", ""), "elaborated": ("own", ""), "simplified": ("", "v")}


def test_package_has_all_buckets_and_extra_ones(spark):
    cards = questions.question_cards(
        spark.createDataFrame([(1, 1, 10, "APPLY", 2), (2, 1, 11, "REMEMBER", 1), (3, 1, 12, None, 1)], LINK),
        spark.createDataFrame([(i, 1, None, "MCQ", f"q{i}", '["x"]', "x") for i in (10, 11, 12)], QUESTION),
    )
    maps = package.question_maps(cards)
    assert maps.select(F.map_keys("questions").alias("k")).first().k == ["remember", "understand", "analyze", "apply"]
    got = maps.first().questions
    assert [c.id for c in got["apply"]] == [10] and got["understand"] == [] and got["remember"][0].correct_answer == "A"


def test_stream_sync_equals_batch(spark, tmp_path):
    from lectern.streaming.question_sync import snapshot, start_sync

    schema = "lesson_id bigint, question_id bigint, bloom_level string, ord bigint, at timestamp"
    spark.createDataFrame([(1, 10, "APPLY", 3, T0), (1, 11, "APPLY", 4, T0)], schema).write.parquet(f"{tmp_path}/in")
    start_sync(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    hour = dt.timedelta(hours=1)
    for k, more in enumerate([[(1, 10, "ANALYZE", 1, T0), (1, 11, "REMEMBER", 9, T0 - hour)], [(1, 12, "APPLY", 2, T0 - hour)]], 1):
        spark.createDataFrame(more, schema).write.mode("append").parquet(f"{tmp_path}/in")
        start_sync(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        rows = {(r.question_id, r.bloom_level, r.ord) for r in snapshot(spark, f"{tmp_path}/out", k).collect()}
        # An older row of a later batch changes nothing.
        assert rows == {(10, "ANALYZE", 1), (11, "APPLY", 4)} | ({(12, "APPLY", 2)} if k == 2 else set())
    assert not (tmp_path / "out" / "0").exists() and (tmp_path / "out" / "1").exists()


def test_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id bigint, x string")
    assert [tuple(r) for r in lookup.by_key(df, "id", 1, strict=True).collect()] == [(1, "a")]
    assert lookup.by_key(df, "id", 9).count() == 0
    for key in (2, 9):
        with pytest.raises(Exception, match="rows found"):
            lookup.by_key(df, "id", key, strict=True).collect()
    keys = spark.createDataFrame([(1,), (9,), (1,), (None,)], "id bigint")
    found = lookup.attach_or_null(keys, df, "id")
    assert sorted(map(str, map(tuple, found.collect()))) == ["(1, 'a')", "(1, 'a')", "(9, None)", "(None, None)"]
    with pytest.raises(Exception, match="id = 2: rows found: 2"):
        lookup.attach_or_null(df.select("id"), df, "id").collect()


def test_row_numbers_of_a_hot_value(spark):
    """Nearly all rows agree in the first column, and no part holds them all."""
    df = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(7).alias("a"), (F.col("id") * 7919 % 5003).alias("b")).repartition(3)
    rows = number_rows(df, [F.col("a").asc_nulls_last(), F.col("b")], "n").collect()
    assert [r.n for r in sorted(rows, key=lambda r: (r.a, r.b))] == list(range(1, 5001))
    empty = number_rows(df.where("false"), [F.col("a"), F.col("b")], "n")
    assert empty.columns == ["a", "b", "n"] and empty.count() == 0


def test_module_view_of_far_ids(spark):
    """Lessons are in order whatever the distance of their ids."""
    ids = [5_000_000_000, 1, 2**62, -(2**40), 3]
    shown = spark.createDataFrame([((1, "m", 1), i, f"Lesson {i}") for i in ids], "module struct<id:bigint,title:string,sequence_order:int>, id bigint, title string")
    shown = shown.select("*", F.create_map().alias("variants"), F.create_map().alias("questions"))
    assert [n.id for n in package.module_view(shown).first().lesson_nodes] == sorted(ids)


def a_course(spark, root):
    outline_rows = [(1, None, 1, 1, "M1", "about"), (2, 1, 1, 2, "N2", ""), (3, None, 2, 1, "M3", "d"), (4, None, 1, 2, "M4", "")]
    return course.Course(
        root,
        spark.createDataFrame([(1, "c1", False), (2, "c2", True)], "id bigint, title string, is_approved boolean"),
        spark.createDataFrame(outline_rows, OUTLINE),
        spark.createDataFrame([(10, None, 2, "completed", T0), (11, 4, None, "pending", T0)], MATERIAL),
        spark.createDataFrame([(100, 10, "text", "T", "words", 1)], OBJECT),
        spark.createDataFrame([(7, 100, "remember", "MCQ", "why?", '["x","y"]', "y")], QUESTION),
        spark.createDataFrame([(1, 1, "Elaborated", "longer", "u")], "id bigint, lesson_id bigint, variant string, narration string, audio_url string"),
    )


def test_course_calls(spark, tmp_path):
    """One course's outline, its first lesson, one lesson's package; unknown ids raise and change nothing."""
    store = a_course(spark, str(tmp_path / "state"))
    with pytest.raises(Exception, match="id = 9: rows found: 0"):
        course.sync_course_outline(spark, store, 9)
    assert snapshot.current_version(spark, store.root) == 0
    active = course.sync_course_outline(spark, store, 1).collect()
    assert sorted((r.id, r.source_id, r.course_id) for r in active) == [(1, 1, 1), (2, 4, 1)]
    lessons = lambda: sorted(tuple(r) for r in snapshot.current(spark, store.root).rows(course.LESSONS).collect())
    assert lessons() == [(1, 1, "material", 10), (2, 2, "outline", 4)] and snapshot.current_version(spark, store.root) == 1
    # The first approved course is the other one: only now it is synced, and what was there stays.
    first = course.first_lesson_node(spark, store).first()
    assert (first.course_id, first.module_id, first.lesson_id, first.source_kind, first.source_id) == (2, 3, 3, "outline", 3)
    assert lessons() == [(1, 1, "material", 10), (2, 2, "outline", 4), (3, 3, "outline", 3)]
    assert course.first_lesson_node(spark, store, 1).first().lesson_id == 1
    with pytest.raises(Exception, match="id = 77: rows found: 0"):
        course.build_package(spark, store, 77)
    for _ in range(2):  # a second call changes nothing
        rows = course.build_package(spark, store, 1).collect()
        assert len(rows) == 1
        p = rows[0]
        assert (p.module.id, p.module.title, p.lesson_node.id, p.lesson_node.title) == (1, "M1", 1, "Lesson 1")
        assert {k: (v.text, v.audio_url) for k, v in p.variants.items()} == {"normal": ("T\nwords", ""), "elaborated": ("longer", "u"), "simplified": ("T\nwords", "")}
        assert {k: [(c.id, c.order, c.correct_answer) for c in v] for k, v in p.questions.items()} == {"remember": [(7, 1, "B")], "understand": [], "analyze": []}
    assert snapshot.current(spark, store.root).rows(course.QUESTIONS).count() == 1
    store.courses = store.courses.where("not is_approved")
    assert course.first_lesson_node(spark, store).count() == 0


def test_snapshot_versions(spark, tmp_path):
    root = str(tmp_path / "state")
    assert snapshot.current_version(spark, root) == 0
    assert snapshot.write_snapshot(spark, root, {"a": spark.range(2), "b": spark.range(3)}) == 1
    grown = snapshot.read_snapshot(spark, root, "a").union(spark.range(5))
    assert snapshot.write_snapshot(spark, root, {"a": grown, "b": spark.range(1)}) == 2
    spark.range(100).write.parquet(f"{root}/a/3")  # a writer that died before its log row
    assert snapshot.read_snapshot(spark, root, "a").count() == 7 and snapshot.read_snapshot(spark, root, "b", 1).count() == 3
    assert snapshot.write_snapshot(spark, root, {"b": spark.range(9)}) == 3  # the other table stays where it is
    assert snapshot.read_snapshot(spark, root, "a").count() == 7 and snapshot.read_snapshot(spark, root, "b").count() == 9
    assert snapshot.read_snapshot(spark, root, "c", empty="id bigint").count() == 0


def test_json_document(spark):
    import json

    from lectern.plans.course_queries import nested_packages

    row = package.as_json(nested_packages(spark, "/root/testdata/sf0.001")).orderBy("lesson_id").first()
    document = json.loads(row.document)
    assert list(document) == ["module", "lesson_node", "variants", "questions"]
    assert document["lesson_node"]["id"] == row.lesson_id and list(document["variants"]) == ["normal", "elaborated", "simplified"]


@pytest.fixture
def small_broadcasts(spark):
    """A broadcast of more than 2 MB fails; a table of any size may not go through the driver by one."""
    name = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(name, "2m")
    yield
    spark.conf.unset(name)


def _wide_outline(spark, tmp_path):
    """One root of course 1 with 100,000 nodes below, as files; its last node bears a material."""
    node = F.struct(F.when(F.col("id") > 0, 0).cast("bigint").alias("parent_id"), F.lit(1).cast("bigint").alias("course_id"), F.lit(0).alias("ord"))
    spark.range(100_001).select("id", node.alias("n")).select("id", "n.*", F.lit("t").alias("title"), F.lit("").alias("description")).write.parquet(f"{tmp_path}/outline")
    return spark.read.parquet(f"{tmp_path}/outline")


def test_walk_sends_no_outline_through_the_driver(spark, tmp_path, small_broadcasts):
    tree = _wide_outline(spark, tmp_path)
    materials = spark.createDataFrame([(7, None, 100_000, "completed", T0), (8, None, 5, "pending", T0)], MATERIAL)
    seeds = outline.roots(tree)
    assert outline.below(spark, tree, seeds).count() == 100_000
    rows = outline.lesson_sources(spark, tree, materials, seeds).collect()
    assert [(r.root_id, r.tier, r.source_kind, r.source_id) for r in rows] == [(0, 2, "material", 7)]


def test_first_lesson_sends_no_outline_through_the_driver(spark, tmp_path, small_broadcasts):
    tree = _wide_outline(spark, tmp_path)
    spark.createDataFrame([(1, 0, True)], MODULE).write.parquet(f"{tmp_path}/modules")
    modules = spark.read.parquet(f"{tmp_path}/modules")
    lessons = spark.createDataFrame([(3, 1, "outline", 0, ""), (2, 1, "material", 9, "")], LESSON)
    courses = spark.createDataFrame([(1, True)], "id bigint, is_approved boolean")
    assert [r.lesson_id for r in select.first_lesson(courses, modules, lessons, tree, 1).collect()] == [3]  # the node's order comes before none


def test_build_package_call_joins_variants_once(spark, monkeypatch):
    """Calls read variants from a table of their own; the join with all lessons would run anew, and be broadcast, in each of them."""
    class Asked(Exception):
        pass

    def asked(spark, store, lesson_id):
        raise Asked(*store.variants.inputFiles())

    monkeypatch.setattr(course_queries, "_course_ids", lambda t: [1])
    monkeypatch.setattr(course, "first_lesson_node", lambda spark, store, c: spark.range(1).select(F.col("id").alias("lesson_id")))
    monkeypatch.setattr(course, "build_package", asked)
    with pytest.raises(Asked) as files:
        course_queries.QUERIES["build_package_call"](spark, "/root/testdata/sf0.001")
    assert files.value.args and all("/variants-" in f for f in files.value.args)
