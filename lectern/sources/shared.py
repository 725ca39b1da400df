"""Tables between the steps of one query, in the folder that driver and executors share.

Each run may have a folder of its own: what is saved inside `with scratch(..)` goes there, and goes with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when the query ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The folder of the innermost `scratch` of this thread.
_FOLDER: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; set to a temporary one only on a single machine where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever Spark can write; what was made from its tables can't be read after."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession, what: str, keep: bool = False) -> Iterator[str]:
    """A folder of its own for the tables that are saved inside, by this thread; it is removed at the end, unless `keep`.

    Results of a query read from the tables that it saved, so they are written or collected inside as well.
    """
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    before = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(before)
        if not keep:
            remove(spark, path)


def write(df: DataFrame, path: str, by: str | None = None, **options: Any) -> None:
    """df as Parquet files at `path`, in folders by the column `by`. The shuffle files of the write go when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        out = df.write.options(**options)
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        if before is None:
            conf.unset(TIDY)
        else:
            conf.set(TIDY, before)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in this thread's scratch folder, or in the shared one."""
    return f"{_FOLDER.get() or shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, **options: Any) -> DataFrame:
    """df written as a table and read again: its lineage ends there, and it is computed once. options: for the Parquet writer."""
    path = fresh_path(df.sparkSession, what)
    write(df, path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)
