"""State: versions, several writers, deltas; calls that read and write what they are about."""

import datetime as dt
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.operators import numbering, outline, snapshot
from lectern.operators.lesson_text import _joined
from lectern.operators.lookup import with_keys
from lectern.plans import course
from lectern.sources.shared import fresh_path, saved, scratch

from .test_course import MATERIAL, OBJECT, OUTLINE, QUESTION, T0

PAIRS = snapshot.Keyed("pairs", "id bigint, k bigint, x bigint, v string", ("k", "x"), "k", buckets=4)


def put(spark, rows):
    """A change that upserts (k, x, v)."""

    def change(before):
        fresh = spark.createDataFrame(rows, "k bigint, x bigint, v string")
        old = before.rows(PAIRS).select("id", "k", "x", F.col("v").alias("_v"))
        changed = fresh.join(old, ["k", "x"], "left").where("id is null or v <> _v")
        return [before.delta(PAIRS, changed.select("id", "k", "x", "v"), ["k", "x"])]

    return change


def pairs(spark, root, **more):
    return sorted(tuple(r) for r in snapshot.current(spark, root).rows(PAIRS, **more).collect())


def test_deltas_compaction_and_vacuum(spark, tmp_path):
    root = str(tmp_path / "state")
    assert pairs(spark, root) == []
    assert snapshot.commit(spark, root, put(spark, [(1, 1, "a"), (2, 1, "b"), (5, 1, "c")])) == 1
    assert snapshot.commit(spark, root, put(spark, [(1, 1, "a2"), (1, 2, "d")])) == 2
    assert snapshot.commit(spark, root, put(spark, [(1, 2, "d")])) == 2  # nothing new, so no version
    want = [(1, 1, 1, "a2"), (2, 2, 1, "b"), (3, 5, 1, "c"), (4, 1, 2, "d")]
    assert pairs(spark, root) == want
    assert pairs(spark, root, only=1) == [want[0], want[3]] and pairs(spark, root, only=9) == []
    assert pairs(spark, root, where=F.col("x") == 2) == [want[3]]
    assert snapshot.compact(spark, root, PAIRS) == 3 and pairs(spark, root) == want
    assert snapshot.compact(spark, root, PAIRS) == 3
    base = snapshot.current(spark, root).tables["pairs"]["base"]
    snapshot.commit(spark, root, put(spark, [(2, 1, "b2"), (6, 1, "e")]))
    assert snapshot.compact(spark, root, PAIRS) == 5
    after = snapshot.current(spark, root).tables["pairs"]
    assert after["base"]["1"] == base["1"] and after["base"]["2"] != base["2"] and after["deltas"] == []  # only the bucket that changed
    want = [(1, 1, 1, "a2"), (2, 2, 1, "b2"), (3, 5, 1, "c"), (4, 1, 2, "d"), (5, 6, 1, "e")]
    assert pairs(spark, root) == want and pairs(spark, root, only=6) == want[4:]
    assert snapshot.vacuum(spark, root) == []  # all too young
    gone = snapshot.vacuum(spark, root, keep=1, hours=0)
    assert len(gone) == 3 and pairs(spark, root) == want
    assert [p.name for p in (tmp_path / "state" / "log").iterdir() if p.suffix == ".json"] == [f"{5:020d}.json"]
    assert snapshot.commit(spark, root, put(spark, [(7, 7, "z")])) == 6


def test_two_writers_from_one_version(spark, tmp_path):
    """Both read the same version; both changes are there in the end, the later one made anew from what the first has left."""
    root = str(tmp_path / "state")
    snapshot.commit(spark, root, put(spark, [(1, 1, "a")]))
    meet, seen = threading.Barrier(2), []

    def writer(rows):
        first = [True]

        def change(before):
            seen.append(before.version)
            deltas = put(spark, rows)(before)
            if first.pop() if first else False:
                meet.wait(60)
            return deltas

        snapshot.commit(spark, root, change)

    threads = [threading.Thread(target=writer, args=([(k, 1, "w"), (1, 1, f"by {k}")],)) for k in (2, 3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(seen) == [1, 1, 2] and snapshot.current_version(spark, root) == 3
    rows = pairs(spark, root)
    assert [r[0] for r in rows] == [1, 2, 3] and {r[1] for r in rows} == {1, 2, 3} and rows[0][3] in ("by 2", "by 3")


def test_a_writer_that_dies_before_its_entry(spark, tmp_path):
    root = str(tmp_path / "state")
    snapshot.commit(spark, root, put(spark, [(1, 1, "a")]))

    def dies(before):
        put(spark, [(2, 2, "lost")])(before)
        raise InterruptedError

    with pytest.raises(InterruptedError):
        snapshot.commit(spark, root, dies)
    assert pairs(spark, root) == [(1, 1, 1, "a")]
    snapshot.commit(spark, root, put(spark, [(3, 3, "b")]))
    assert pairs(spark, root) == [(1, 1, 1, "a"), (2, 3, 3, "b")]
    assert len(snapshot.vacuum(spark, root, hours=0)) == 1 and len(pairs(spark, root)) == 2


@pytest.mark.parametrize("link", [None, False])
def test_one_of_many_puts_an_entry(spark, tmp_path, link):
    """By a link on a disk; by a rename that does not overwrite elsewhere (one after the other here, as a disk's rename is not atomic)."""
    path, done = str(tmp_path / "entry"), []
    put_one = lambda k: done.append((snapshot.put_if_absent(spark, path, f"text {k}", link), k))
    threads = [threading.Thread(target=put_one, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
        if link is False:
            t.join()
    [t.join() for t in threads]
    won = [k for ok, k in done if ok]
    assert len(won) == 1 and Path(path).read_text() == f"text {won[0]}"
    assert not list(tmp_path.glob("*.draft"))


def test_whole_tables_of_a_stale_base(spark, tmp_path):
    root = str(tmp_path / "state")
    assert snapshot.write_snapshot(spark, root, {"a": spark.range(2)}, base=0) == 1
    with pytest.raises(snapshot.Conflict):
        snapshot.write_snapshot(spark, root, {"a": spark.range(3)}, base=0)
    assert snapshot.read_snapshot(spark, root, "a").count() == 2


def a_store(spark, root):
    """Two courses; below root 1 of course 1 lie nodes of course 2 and of no course."""
    nodes = [(1, None, 1, 1, "R1", ""), (2, 1, 2, 1, "N2", ""), (3, 2, None, 1, "N3", ""), (4, None, 2, 1, "R4", "about"), (5, None, 1, 2, "R5", "d")]
    materials = [(10, None, 3, "completed", T0), (11, None, 2, "completed", T0 + dt.timedelta(1)), (12, 5, None, "completed", T0), (13, None, 5, "pending", T0)]
    objects = [(100 + k, m, "text", f"T{k}", "words", k) for k, m in enumerate((10, 10, 11, 12, 13))]
    questions = [(200 + k, 100 + k % 5, "remember", "MCQ", f"q{k}", '["x","y"]', "y") for k in range(12)]
    return course.Course(
        root,
        spark.createDataFrame([(1, "c1", True), (2, "c2", True)], "id bigint, title string, is_approved boolean"),
        spark.createDataFrame(nodes, OUTLINE), spark.createDataFrame(materials, MATERIAL), spark.createDataFrame(objects, OBJECT), spark.createDataFrame(questions, QUESTION),
        spark.createDataFrame([], "id bigint, lesson_id bigint, variant string, narration string, audio_url string"),
    )


def test_sources_below_a_root_of_any_course(spark, tmp_path):
    store = a_store(spark, str(tmp_path / "state"))
    assert sorted(r.source_id for r in course.sync_course_outline(spark, store, 1).collect()) == [1, 5]
    lessons = snapshot.current(spark, store.root).rows(course.LESSONS).collect()
    assert sorted((r.id, r.module_id, r.source_kind, r.source_id) for r in lessons) == [(1, 1, "material", 10), (2, 1, "material", 11), (3, 2, "material", 12)]
    version = snapshot.current_version(spark, store.root)
    course.sync_course_outline(spark, store, 1)
    assert snapshot.current_version(spark, store.root) == version  # a second call changes nothing, and writes nothing
    course.sync_course_outline(spark, store, 2)
    assert snapshot.current(spark, store.root).rows(course.LESSONS).count() == 4


def test_two_clients_sync_at_once(spark, tmp_path):
    store = a_store(spark, str(tmp_path / "state"))
    threads = [threading.Thread(target=course.sync_course_outline, args=(spark, store, c)) for c in (1, 2)]
    [t.start() for t in threads], [t.join() for t in threads]
    state = snapshot.current(spark, store.root)
    assert sorted(r.id for r in state.rows(course.MODULES).collect()) == [1, 2, 3]
    assert sorted(r.id for r in state.rows(course.LESSONS).collect()) == [1, 2, 3, 4]


def size(root):
    return sum(p.stat().st_size for p in Path(root).glob("module_questions/**/*.parquet"))


def test_a_package_writes_its_own_lesson(spark, tmp_path):
    """What a package writes is the same however many questions other lessons have; a package that changes nothing writes nothing."""
    written = []
    for k, others in enumerate((0, 50_000)):
        store = a_store(spark, str(tmp_path / f"state{k}"))
        course.sync_course_outline(spark, store, 1)
        if others:
            rows = spark.range(others).select(F.lit(None).cast("bigint").alias("id"), (F.col("id") % 500 + 1000).alias("lesson_id"), F.col("id").alias("question_id"), F.lit("APPLY").alias("bloom_level"), F.lit(1).cast("bigint").alias("ord"))
            snapshot.commit(spark, store.root, lambda before, rows=rows: [before.delta(course.QUESTIONS, rows, ["lesson_id", "question_id"])])
            snapshot.compact(spark, store.root, course.QUESTIONS)
        before = size(store.root)
        assert len(course.build_package(spark, store, 1).first().questions["remember"]) == 6
        written.append(size(store.root) - before)
        version = snapshot.current_version(spark, store.root)
        course.build_package(spark, store, 1)
        assert snapshot.current_version(spark, store.root) == version and size(store.root) - before == written[-1]
    assert abs(written[0] - written[1]) < 100 and written[0] > 0


def test_a_package_reads_by_its_keys(spark, tmp_path):
    """Scans of objects, questions, outline and links carry the lesson's keys."""
    store = a_store(spark, str(tmp_path / "state"))
    course.sync_course_outline(spark, store, 1)
    for name in ("outline", "materials", "objects", "questions", "variants"):
        getattr(store, name).write.parquet(str(tmp_path / name))
        setattr(store, name, spark.read.parquet(str(tmp_path / name)))
    df = course.build_package(spark, store, 1)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    of = lambda column: [s for s in scans if column in s.split("ReadSchema")[1]]
    for column, key in (("material_id", "EqualTo(material_id,10)"), ("question_text", "In(id, [200,201,205,206,210,211])"), ("bloom_level:string,ord", "EqualTo(lesson_id,1)"), ("narration", "EqualTo(lesson_id,1)")):
        assert of(column), (column, scans)
        for s in of(column):
            assert key.split("(")[1].split(",")[0] in s.split("PushedFilters")[1] and ("In(" in s or "EqualTo(" in s), (column, s)
    assert df.count() == 1


def test_keys_in_a_filter_or_a_join(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    keys = spark.createDataFrame([(3,), (3,), (None,), (500,), (7,)], "k bigint")
    for most in (1000, 1):
        out = with_keys(df, "id", keys, most)
        assert (out.columns, sorted(r.v for r in out.collect())) == (["id", "v"], [6, 14])
    assert with_keys(df, "id", keys.where("false")).count() == 0


@pytest.mark.parametrize("most", [10**6, 300])
def test_sums_within_keys(spark, many_parts, most):
    """One key has half the rows; dealt by range, no part has them all."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 41 == 0, None).otherwise(F.col("id") % 30).alias("k"), (F.col("id") * 7919 % 4003).alias("o"), (F.col("id") % 5).alias("v"))
    got = numbering.running_sum(rows, "k", [F.col("o")], F.col("v"), "s", most).collect()
    want, sums = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        sums[r.k] = sums.get(r.k, 0) + r.v
        want[r.o] = sums[r.k]
    assert {r.o: r.s for r in got} == want and len(got) == 4000
    numbers = numbering.number_within(rows, "k", [F.col("o")], "n", most).where("k = 7").collect()
    assert sorted(r.n for r in numbers) == list(range(1, 2132))
    if most == 300:
        parts = numbering.dealt_by_range(rows.where("k = 7"), "k", [F.col("o")]).groupBy("_part").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 1500


@pytest.mark.parametrize("most", [10**6, 50])
def test_texts_of_many_pieces(spark, many_parts, most):
    rows = [(k % 3 if k % 10 else 9, None if k % 17 == 0 else k * 37 % 101, k, "" if k % 13 == 0 else f"p{k}") for k in range(600)]
    got = {r.key: r.lesson_text for r in _joined(spark.createDataFrame(rows, "key int, o int, id int, piece string").repartition(3), "key", ["o", "id"], most).collect()}
    order = lambda r: (r[1] is None, r[1] or 0, r[2])
    assert got == {key: "\n\n".join(r[3] for r in sorted((r for r in rows if r[0] == key), key=order) if r[3]) for key in (0, 1, 2, 9)}


def test_runs_keep_to_their_scratch(spark):
    """A run that ends removes its own tables, whatever others write meanwhile."""
    inside, go = threading.Event(), threading.Event()
    kept = {}

    def other():
        with scratch(spark, "other"):
            table = saved(spark.range(5), "table")
            inside.set()
            go.wait(60)
            kept["n"] = table.count()

    t = threading.Thread(target=other)
    t.start()
    inside.wait(60)
    with scratch(spark, "mine") as folder:
        path = fresh_path(spark, "table")
        assert path.startswith(folder)
        assert saved(spark.range(3), "table").count() == 3
        with scratch(spark, "inner") as inner:
            assert saved(spark.range(3), "table").inputFiles()[0].removeprefix("file://").startswith(inner.removeprefix("file:"))
    go.set()
    t.join()
    assert kept["n"] == 5
    place = folder.removeprefix("file:")
    assert not Path(place).exists() and not Path(inner.removeprefix("file:")).exists()


def test_outline_below_given_roots(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4), (6, 5)], "id bigint, parent_id bigint")
    for levels in (64, 1):
        got = outline.below(spark, df, df.where("id in (1, 2)"), levels).collect() if levels == 64 else outline.below(spark, df, df.where("id = 1"), levels).collect()
        assert sorted((r.root_id, r.id) for r in got) == ([(1, 2), (1, 3), (2, 3)] if levels == 64 else [(1, 2), (1, 3)])
