"""Question sync on a stream: each micro-batch is merged into the stored snapshot. (`keyed_sync` costs less where the state is large.)

The state after all batches equals one batch merge of the last number and level seen
per (lesson, question): the one of the latest `at`, whatever batch it comes in; at a tie the later batch's, within a batch
the greatest (ord, bloom_level); a null `at` counts as the beginning of 1970.
Snapshots are whole new folders; a batch that is retried writes the folder of its own batch id again, so each
batch counts once. Folders older than the one that a retry reads are removed. A batch costs a pass over the state,
so triggers should be as far apart as the state is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.snapshot import no_rows
from lectern.operators.sync import sync_questions

STATE = "id bigint, lesson_id bigint, question_id bigint, bloom_level string, ord bigint, at timestamp"


def snapshot(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The state after a batch; before the first one it is empty."""
    return no_rows(spark, STATE) if batch_id < 0 else spark.read.schema(STATE).parquet(f"{path}/{batch_id}")


def merged(before: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after rows (lesson_id, question_id, bloom_level, ord, at)."""
    keys = ["lesson_id", "question_id"]
    timed = batch.withColumn("at", F.coalesce("at", F.timestamp_micros(F.lit(0))))
    latest = timed.groupBy(*keys).agg(F.max(F.struct("at", "ord", "bloom_level")).alias("r")).select(*keys, "r.*")
    newer = latest.join(before.select(*keys, F.col("at").alias("_before")), keys, "left").where("_before is null or at >= _before").drop("_before")
    after = sync_questions(before.drop("at"), newer.drop("at"))
    seen = before.select(*keys, "at").unionByName(newer.select(*keys, "at")).groupBy(*keys).agg(F.max("at").alias("at"))
    return after.join(seen, keys, "left").select("id", *keys, "bloom_level", "ord", "at")


def start_sync(fresh: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """fresh: a stream of (lesson_id, question_id, bloom_level, ord, at)."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged(snapshot(spark, path, batch_id - 1), batch).write.mode("overwrite").parquet(f"{path}/{batch_id}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{batch_id - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
