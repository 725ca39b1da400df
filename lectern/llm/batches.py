"""Arrow batches in tasks: bounded slices of texts, columns appended to rows, and compressed tables between steps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources import shared

#: Text bytes that are worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch between the JVM and Python; each task holds a few on either side.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


#: What outlives a task in its Python worker: one object, such as an encoder with what it has learned.
_KEPT: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """The object of that key, made if need be; any other is freed."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Frees what is kept. (A module's function, as a task's own function would have copies of the module's names.)"""
    _KEPT.clear()


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keeps: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded size, which counts where texts are long. It sets that size for the session.

    Workers serve one task after another: freed memory goes back at a task's end, and what a task of
    another operator has kept goes at its start, unless `keeps`.
    """
    df.sparkSession.conf.set(BATCH, str(BATCH_BYTES))

    def tidily(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidily, schema)


def give_back() -> None:
    """Free memory of Arrow's pool and, where the C library can do it, of the allocator."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most `limit` bytes together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list]], drop: bool = False, keeps: bool = False) -> DataFrame:
    """Appends columns computed from the text column, row by row, with no shuffle; `drop` leaves the text behind in the task.

    make() runs once a task and returns a function of a string array (nulls stay null) that gives
    one array per field. A field whose name df has already gets underscores in front.
    """
    kept = [c for c in df.columns if not (drop and c == text)]
    schema = T.StructType([*[df.schema[c] for c in kept], *fresh_fields(df.select(*kept), fields)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *compute(texts)], names=names)

    return in_tasks(df, run, schema, keeps)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fresh_fields(df: DataFrame, fields: list[T.StructField]) -> list[T.StructField]:
    return [T.StructField(fresh_name(df, f.name), f.dataType) for f in fields]


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def write(df: DataFrame, path: str, by: str | None = None, **options: Any) -> None:
    """df as compressed Parquet files at `path`, in folders by the column `by`."""
    shared.write(df, path, by, **{"compression": "zstd"} | options)


def saved(df: DataFrame, what: str, **options: Any) -> DataFrame:
    """df written as a compressed table and read again: its lineage ends there. It goes with the scratch folder that it lies in."""
    return shared.saved(df, what, **{"compression": "zstd"} | options)
