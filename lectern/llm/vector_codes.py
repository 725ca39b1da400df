"""Product codes of vectors: Lloyd's rounds with Elkan's bounds, in integers.

A vector is cut into equal consecutive parts, and each part position has a codebook. A round assigns every part to its nearest
entry and then moves each entry to the floored mean of its parts. Between rounds each row keeps, of every part, an upper bound of the
distance to its entry and a lower bound of the distance to each entry. By the triangle inequality an entry is passed over if

    its lower bound, less what the entry has moved since, is above the upper bound, or
    half its distance to the own entry is above the upper bound,

both strictly, so that no tie is lost; what is left is decided by exact squared distances, ties by the lower index.
The bounds are kept relative to all that an entry has moved so far, so a round that finds nothing new about an entry writes
the same bound again. A lower bound is a multiple, rounded down, of a quarter of the first distance of that part, up to 15 times.

Rows with their bounds are a table of the shared folder, written anew in each round, the one before removed; a
lost executor costs its tasks. What goes through the driver is the codebooks, entries and their sums, whatever the number of rows.

Edge cases: rows whose vector is null or has null or non-finite components are left out; a vector of another length than that of the
least id has no code (null code and error); the first length must be a multiple of the number of parts; ids may be null (they come
last), repeated or tied (then the vectors decide); with fewer rows than entries there are as many entries as rows; an
empty table gives none; a new column whose name is taken gets underscores in front. Integers beyond
sqrt(2**52 / length) (8 million at 64 components) raise an error, as distances might not be exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.batches import fresh_name, in_tasks, saved, write
from lectern.sources.shared import fresh_path, remove

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are worked on at once: their bounds take a kilobyte each.
ROWS = 2048
#: Steps of a lower bound in the first distance of its part, and the most that are told apart: few, so that the bounds compress to a third.
STEPS, MOST_STEPS = 4, 15
#: What float arithmetic may be wrong by, many times over; bounds give way by it.
SLACK = 1e-6
#: Labels whose sums go to every task; sums of more are joined.
MANY = 100_000

_BYTES = T.BinaryType()


def sound(vector: Column) -> Column:
    """Whether there is a vector and all its components are finite numbers."""
    v = vector.cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, fine), F.lit(False))


def integers(batch: pa.RecordBatch, vector: str, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, a row a vector."""
    flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = np.floor(flat * scale)
    if len(found) and np.abs(found).max() >= np.sqrt(2.0**52 / dim):
        raise ValueError("components are too large for exact distances")
    return found.astype(np.int64).reshape(-1, dim)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of y."""
    x2, y2 = (x * x).sum(1), (y * y).sum(1)
    if 4.0 * max(x2.max(initial=0), y2.max(initial=0)) < 2.0**53:
        cross = (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)  # every sum is an integer below 2**53
    else:
        cross = x @ y.T
    return x2[:, None] - 2 * cross + y2


@dataclass
class Book:
    """One part's entries, how far each has moved in all rounds (rounded up), and half the distances between them (rounded down)."""

    entries: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        self.half = np.maximum(np.sqrt(squared(self.entries, self.entries)) / 2 - SLACK, 0)
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1)

    def after(self, entries: np.ndarray) -> Book:
        step = np.sqrt(((entries - self.entries) ** 2).sum(1).astype(np.float64))
        return Book(entries, self.moved + np.where(step > 0, step + SLACK, 0))


@dataclass
class Bounds:
    """Of each row's part: its entry, the upper bound less what the entry had moved, the step, and the lower bounds in steps."""

    code: np.ndarray  # uint8
    upper: np.ndarray  # float64
    step: np.ndarray  # float32
    lower: np.ndarray  # uint8, a column an entry


def _steps(distance: np.ndarray, moved: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((distance - SLACK + moved) / step), 0, MOST_STEPS).astype(np.uint8)


def first_bounds(x: np.ndarray, book: Book) -> Bounds:
    """The nearest entries and all bounds, from all distances."""
    found = squared(x, book.entries)
    code = found.argmin(axis=1)  # the first of equal ones
    distance = np.sqrt(found)
    own = distance[np.arange(len(x)), code]
    step = (np.maximum(own, 1) / STEPS).astype(np.float32)
    return Bounds(code.astype(np.uint8), own + SLACK - book.moved[code], step, _steps(distance, book.moved, step.astype(np.float64)[:, None]))


def next_bounds(x: np.ndarray, book: Book, bounds: Bounds) -> tuple[Bounds, int]:
    """The nearest entries after these moved, and how many distances were computed."""
    code, high, lower = bounds.code.astype(np.int64), bounds.upper.copy(), bounds.lower.copy()
    rows = np.flatnonzero(high + book.moved[code] + SLACK >= book.nearest[code])
    own = ((x[rows] - book.entries[code[rows]]) ** 2).sum(1)
    counted = len(rows)
    distance = np.sqrt(own)
    step = bounds.step.astype(np.float64)
    high[rows] = distance + SLACK - book.moved[code[rows]]
    lower[rows, code[rows]] = _steps(distance, book.moved[code[rows]], step[rows])
    some = distance + SLACK >= book.nearest[code[rows]]
    rows, own, distance = rows[some], own[some], distance[some]
    near = lower[rows] * step[rows, None] - book.moved <= distance[:, None] + SLACK
    near &= book.half[code[rows]] <= distance[:, None] + SLACK
    near[np.arange(len(rows)), code[rows]] = False
    r, c = np.nonzero(near)
    found = ((x[rows[r]] - book.entries[c]) ** 2).sum(1)
    lower[rows[r], c] = _steps(np.sqrt(found), book.moved[c], step[rows[r]])
    best = own << 8 | code[rows]
    np.minimum.at(best, r, found << 8 | c)
    code[rows] = best & 255
    high[rows] = np.sqrt(best >> 8) + SLACK - book.moved[code[rows]]
    return Bounds(code.astype(np.uint8), high, bounds.step, lower), counted + len(r)


#: What the table of a round has besides the columns that are kept: integers, entries, bounds, and how many distances the round took.
_STATE = [T.StructField(n, _BYTES) for n in ("_x", "_code", "_upper", "_step", "_lower")] + [T.StructField("_distances", T.LongType())]


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width or 1, dtype=np.int32)[: len(rows) + 1]), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind: str, n: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(n, -1)


def _round(df: DataFrame, own: list[str], books: list[Book], vector: str | None, dim: int, scale: int) -> DataFrame:
    """Rows of `own` with integers, entries and bounds: from the vectors, or from the table of the round before."""
    schema = T.StructType([*[df.schema[c] for c in own], *_STATE])
    parts = len(books)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                taken = np.zeros(n, np.int64)
                if vector:
                    x = integers(batch, vector, dim, scale)
                    found = [first_bounds(xs, book) for xs, book in zip(np.split(x, parts, axis=1), books)]
                    taken[0] = sum(n * len(b.entries) for b in books)
                else:
                    x = _matrix(batch.column("_x"), "<i4", n).astype(np.int64)
                    code, step = _matrix(batch.column("_code"), "u1", n), _matrix(batch.column("_step"), "<f4", n)
                    upper, lower = _matrix(batch.column("_upper"), "<f8", n), np.split(_matrix(batch.column("_lower"), "u1", n), parts, axis=1)
                    found = []
                    for k, (xs, book) in enumerate(zip(np.split(x, parts, axis=1), books)):
                        bounds, counted = next_bounds(xs, book, Bounds(code[:, k], upper[:, k], step[:, k], lower[k]))
                        found.append(bounds)
                        taken[0] += counted
                stacked = [np.stack([getattr(b, f) for b in found], axis=1) for f in ("code", "upper", "step")]
                lower = np.concatenate([b.lower for b in found], axis=1)
                new = [_binary(x.astype("<i4")), *map(_binary, stacked), _binary(lower), pa.array(taken)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *new], names=schema.names)

    return in_tasks(df, run, schema)


def _moved(state: DataFrame, books: list[Book], dim: int) -> list[Book]:
    """The books with each entry at the floored mean of its parts; entries without parts stay. Sums are made in tasks, then by entry and position."""
    parts, size, width = len(books), len(books[0].entries), dim // len(books)

    def run(batches):
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            x = _matrix(batch.column("_x"), "<i4", batch.num_rows).astype(np.int64) if batch.num_rows else np.zeros((0, dim), np.int64)
            code = _matrix(batch.column("_code"), "u1", batch.num_rows) if batch.num_rows else np.zeros((0, parts), np.uint8)
            for k in range(parts):
                order = np.argsort(code[:, k], kind="stable")
                own, at = np.unique(code[order, k], return_index=True)
                if len(own):
                    sums[k, own] += np.add.reduceat(x[order, k * width : (k + 1) * width], at, axis=0)
                    counts[k] += np.bincount(code[:, k], minlength=size)
        k, c = np.nonzero(counts)
        values = sums[k, c]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(counts[k, c]), lists], names=["part", "entry", "n", "sums"])

    each = in_tasks(state.select("_x", "_code"), run, "part int, entry int, n long, sums array<long>")
    spread = each.select("part", "entry", "n", F.posexplode("sums").alias("position", "value"))
    summed = spread.groupBy("part", "entry", "position").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    entries = [b.entries.copy() for b in books]
    for r in summed.toLocalIterator():  # as many rows as the books have numbers
        entries[r.part][r.entry, r.position] = r.value // r.n
    return [b.after(e) for b, e in zip(books, entries)]


def first_books(kept: DataFrame, order: str, vector: str, parts: int, entries: int, scale: int) -> tuple[list[Book], int]:
    """The parts of the first rows by id as entries, and the vectors' length; no book if there is no row."""
    dim = kept.orderBy(F.col(order).asc_nulls_last(), vector).limit(1).select(F.size(vector).alias("n")).first()
    if dim is None:
        return [], 0
    if dim.n % parts:
        raise ValueError(f"vectors of {dim.n} components can't be cut into {parts} equal parts")
    first = kept.where(F.size(vector) == dim.n).orderBy(F.col(order).asc_nulls_last(), vector).limit(entries).select(F.col(vector).cast("array<double>").alias("v"))
    rows = np.floor(np.array([r.v for r in first.collect()], np.float64).reshape(-1, dim.n) * scale).astype(np.int64)  # at most `entries` rows
    return [Book(x, np.zeros(len(rows))) for x in np.split(rows, parts, axis=1)], dim.n


@dataclass
class _Stored:
    table: DataFrame
    path: str


def _stored(df: DataFrame, what: str) -> _Stored:
    path = fresh_path(df.sparkSession, what)
    write(df, path)
    return _Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


def _total(state: _Stored) -> int:
    return state.table.agg(F.sum("_distances")).first()[0]


def digest(books: list[Book]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


@dataclass
class Coded:
    """Rows without their vector, with `code` (two hex digits a part) and `error` (squared distances over all parts); the final books; distances taken a round."""

    rows: DataFrame
    books: list[Book]
    distances: list[int]
    code: str
    error: str


def encode(df: DataFrame, order: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Coded:
    """Codes of all sound vectors after `rounds` rounds; what is kept of each row is all its other columns."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part, so there are at most 256 entries")
    own = [c for c in df.columns if c != vector]
    code, error = fresh_name(df.select(*own), "code"), fresh_name(df.select(*own), "error")
    kept = df.where(sound(F.col(vector)))
    books, dim = first_books(kept, order, vector, parts, entries, scale)
    none = kept.select(*own, vector, F.lit(None).cast("string").alias(code), F.lit(None).cast("long").alias(error))
    if not books or not dim:
        return Coded(none.drop(vector), books, [], code, error)
    inner = [f"_{k}" for k in range(len(own))]  # whatever the columns' names are
    named = kept.where(F.size(vector) == dim).select(*[F.col(c).alias(i) for c, i in zip(own, inner)], F.col(vector).cast("array<double>").alias("_v"))
    state = _stored(_round(named, inner, books, "_v", dim, scale), "bounds")
    distances = [_total(state)]
    for _ in range(rounds):
        books = _moved(state.table, books, dim)
        before, state = state, _stored(_round(state.table, inner, books, None, dim, scale), "bounds")
        remove(df.sparkSession, before.path)
        distances.append(_total(state))
    schema = T.StructType([*[state.table.schema[c] for c in inner], T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])

    def finish(batches):
        for batch in batches:
            n = batch.num_rows
            x, codes = _matrix(batch.column("_x"), "<i4", n).astype(np.int64), _matrix(batch.column("_code"), "u1", n)
            far = sum(((xs - b.entries[codes[:, k]]) ** 2).sum(1) for k, (xs, b) in enumerate(zip(np.split(x, parts, axis=1), books)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in inner], pa.array([bytes(r).hex() for r in codes]), pa.array(far)], names=schema.names)

    done = saved(in_tasks(state.table.select(*inner, "_x", "_code"), finish, schema), "codes")
    remove(df.sparkSession, state.path)
    back = done.select(*[F.col(i).alias(c) for i, c in zip(inner, own)], code, error)
    return Coded(back.unionByName(none.where(F.size(vector) != dim).drop(vector)), books, distances, code, error)


def with_label_error(rows: DataFrame, label: str, error: str, many: int = MANY, salts: int = 64) -> DataFrame:
    """rows with label_error, the sum of errors over rows of an equal label, nulls together.

    Sums combine before the shuffle. Up to `many` of them go to every task; more are joined, each in `salts` copies, so that a
    frequent label's rows are dealt to many tasks.
    """
    name, spark = fresh_name(rows, "label_error"), rows.sparkSession
    sums = saved(rows.groupBy(F.col(label).alias("_label")).agg(F.sum(error).alias("_sum")), "labels")
    if sums.count() <= many:
        joined = rows.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label")))
    else:
        salted = rows.withColumn("_salt", (F.xxhash64(*[c for c in rows.columns]) % salts + salts) % salts)
        copies = sums.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = salted.join(copies, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_copy")))
    return joined.select(*rows.columns, F.col("_sum").alias(name))
