"""Streams: keyed state equals one batch merge, in any order of rows and batches."""

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from lectern.operators import snapshot
from lectern.streaming import keyed_sync, question_sync

SCHEMA = "lesson_id bigint, question_id bigint, bloom_level string, ord bigint, at timestamp"
T0 = dt.datetime(2024, 1, 1)


def merged(rows):
    """{(lesson, question): (level, ord, at)}: the latest row, at a tie the greatest."""
    out = {}
    for lesson, question, level, o, at in rows:
        if lesson is None or question is None:
            continue
        at = at or dt.datetime(1970, 1, 1)
        rank = (at, o is not None, o or 0, level is not None, level or "")
        if (lesson, question) not in out or rank > out[lesson, question][0]:
            out[lesson, question] = rank, (level, o, at)
    return {k: v for k, (_, v) in out.items()}


def run(spark, tmp_path, batches):
    written = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        keyed_sync.start_sync(stream, f"{tmp_path}/state", f"{tmp_path}/ck").awaitTermination()
        written.append(sum(p.stat().st_size for p in Path(f"{tmp_path}/state/module_questions").glob("**/*.parquet")))
    return written


def test_any_order_gives_the_batch_merge(spark, tmp_path):
    r = random.Random(3)
    times = [None, T0, T0 + dt.timedelta(hours=1), T0 - dt.timedelta(hours=9)]
    rows = [(r.choice([1, 1, 2, 3, None]), r.randrange(12), r.choice(["APPLY", "REMEMBER", None]), r.choice([None, 1, 2, 3]), r.choice(times)) for _ in range(160)]
    for k, order in enumerate((rows, r.sample(rows, len(rows)))):
        run(spark, tmp_path / str(k), [order[:70], order[70:110], order[110:]])
        got = keyed_sync.stored(spark, f"{tmp_path}/{k}/state").collect()
        assert {(x.lesson_id, x.question_id): (x.bloom_level, x.ord, x.at) for x in got} == merged(rows)
        assert sorted(x.id for x in got) == list(range(1, len(got) + 1))


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    many = [(k % 300, k, "APPLY", k, T0) for k in range(20_000)]
    late = [(5, 5, "OLD", 1, T0 - dt.timedelta(days=1))]
    written = run(spark, tmp_path, [many, [(1, 1, "REMEMBER", 7, T0 + dt.timedelta(days=1)), *late], late])
    assert written[1] - written[0] < written[0] / 20 and written[2] == written[1]
    root = f"{tmp_path}/state"
    version = snapshot.current_version(spark, root)
    again = spark.createDataFrame([(1, 1, "REMEMBER", 7, T0 + dt.timedelta(days=1))], SCHEMA)
    assert keyed_sync.put(spark, root, again) == version == 2  # a retried batch finds its rows there
    snapshot.compact(spark, root, keyed_sync.TABLE)
    got = keyed_sync.stored(spark, root)
    assert got.count() == 20_000 and got.where("lesson_id = 1 and question_id = 1").first().ord == 7
    assert got.where("lesson_id = 5 and question_id = 5").first().bloom_level == "APPLY"


def test_merge_of_null_and_tied_times(spark):
    none = spark.createDataFrame([], question_sync.STATE)
    rows = [(1, 1, "A", 4, None), (1, 2, "B", 1, T0), (1, 2, "C", 2, T0), (1, 3, "D", 1, None), (1, 3, "E", 1, T0)]
    got = question_sync.merged(none, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.question_id: (x.bloom_level, x.ord) for x in got} == {1: ("A", 4), 2: ("C", 2), 3: ("E", 1)}
