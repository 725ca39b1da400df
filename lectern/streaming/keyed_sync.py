"""Question sync on a stream by keyed state: a micro-batch costs what it holds, not what is stored.

The state store has, of each (lesson, question), the row that counts: the one of the latest `at`, at a tie the greatest
(ord, bloom_level), whatever batch it comes in and in whatever order; a null `at` counts as the beginning of 1970. Rows that change what
counts are put into the course state as a delta of their own, with ids as a call would give. A batch that is retried finds its rows
already there and writes nothing. Rows without lesson or question are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lectern.operators.lookup import with_keys
from lectern.operators.snapshot import Delta, Keyed, Snapshot, commit, current

TABLE = Keyed(
    "module_questions", "id bigint, lesson_id bigint, question_id bigint, bloom_level string, ord bigint, at timestamp", ("lesson_id", "question_id"), "lesson_id"
)
_KEYS = ["lesson_id", "question_id"]
_ROW = "bloom_level string, ord bigint, at bigint"  # at in microseconds, the same in every time zone
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rank(bloom_level: str | None, ord_: int | None, at: int) -> tuple:
    return at, ord_ is not None, ord_ or 0, bloom_level is not None, bloom_level or ""


class Latest(StatefulProcessor):
    """Of one (lesson, question) the row that counts; gives it when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", _ROW)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = tuple(self.row.get()) if self.row.exists() else None
        before = best
        for r in rows:
            new = (r.bloom_level, r.ord, r.at)
            if best is None or _rank(*new) > _rank(*best):
                best = new
        if best != before:
            self.row.update(best)
            yield Row(lesson_id=key[0], question_id=key[1], bloom_level=best[0], ord=best[1], at=best[2])

    def close(self) -> None:
        pass


def latest(fresh: DataFrame) -> DataFrame:
    """Rows of a stream (lesson_id, question_id, bloom_level, ord, at) that change what counts. State is dealt by lesson and question, so a large lesson is spread."""
    rows = fresh.where("lesson_id is not null and question_id is not null").withColumn("at", F.coalesce(F.unix_micros("at"), F.lit(0)))
    kind = f"lesson_id bigint, question_id bigint, {_ROW}"
    return rows.select(*_KEYS, "bloom_level", "ord", "at").groupBy(*_KEYS).transformWithState(Latest(), kind, "Update", "None").withColumn("at", F.timestamp_micros("at"))


def put(spark: SparkSession, root: str, rows: DataFrame) -> int:
    """Rows of different keys into the state at `root`, where they differ from what is there; returns the version that has them."""

    def change(before: Snapshot) -> list[Delta]:
        there = with_keys(before.rows(TABLE), "lesson_id", rows.select("lesson_id"))
        old = there.select("id", *_KEYS, *[F.col(c).alias(f"_{c}") for c in ("bloom_level", "ord", "at")])
        both = rows.join(old, _KEYS, "left")
        same = F.col("bloom_level").eqNullSafe(F.col("_bloom_level")) & F.col("ord").eqNullSafe(F.col("_ord")) & F.col("at").eqNullSafe(F.col("_at"))
        return [before.delta(TABLE, both.where(F.col("id").isNull() | ~same).select("id", *_KEYS, "bloom_level", "ord", "at"), [*_KEYS])]

    return commit(spark, root, change)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(id, lesson_id, question_id, bloom_level, ord, at) as it is now."""
    return current(spark, root).rows(TABLE)


def start_sync(fresh: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """fresh: a stream of (lesson_id, question_id, bloom_level, ord, at). It takes what is there and ends; the next start goes on."""
    spark = fresh.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the commit reads it more than once
        try:
            put(batch.sparkSession, root, batch)
        finally:
            batch.unpersist()

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # keyed state of this kind needs it; a query keeps the settings of its start
    try:
        stream = latest(fresh).writeStream.foreachBatch(write).outputMode("update")
        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
