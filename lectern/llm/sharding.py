"""Sharding by histogram sort, in DataFrame operations alone.

Rows are put in the order of a 63-bit key: the text's crc32, then 20 bits of the doc_id's, then a
salt of the row's place in the input. Equal texts are neighbours in it, and yet a very large group of
them can be cut, by the salt even if doc_ids agree too. The key range is cut
into cells; one aggregation counts exact bytes and rows per cell, which gives the bytes below every
candidate boundary. Cells that hold a wanted boundary and are not yet precise enough are cut finer
and counted again, until each splitter meets its tolerance. Then whole rows move once, to the ranges
between splitters, and are written, one folder per shard, in slot order within files. Sizes, checksums
and slots come from what was written.

Two families of splitters come out of the same counts: the shards' own, equal in bytes, and those
of ranges that are equal in rows, which only keep tasks small: a shard is a run of ranges, and a
row's slot is its range's offset plus its place in the range.

Only counts of cells reach the driver, at most CELLS for each boundary and round.

Edge cases: null reads as empty text, size 1; a null doc_id counts as empty text in the key; rows
with null or repeated doc_ids are each placed once; should the salt differ when the input is read again,
shards are a little less even, but still whole; an empty table has no row; fewer rows than shards leave
shards empty. Other columns move with their row.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.batches import fresh_name, saved, write
from lectern.sources.shared import fresh_path

KEY_BITS, SALT_BITS = 63, 11
#: Each cell is cut in so many, 2 ** 9.
CELL_BITS = 9
CELLS = 1 << CELL_BITS
SHARDS = 8
#: A shard's bytes may miss an equal share by this part of it; a range's rows may miss theirs by half.
TOLERANCE, RANGE_TOLERANCE = 0.001, 0.5
#: Ranges equal in rows, each one task's sort of whole rows: at least so many, more for so many bytes each, and at most.
RANGES, RANGE_BYTES, MOST_RANGES = 256, 64 << 20, 2048


def sort_key(text: Column, doc_id: Column) -> Column:
    """63 bits; all parts are spread evenly."""
    low = F.shiftright(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 12)
    salt = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - SALT_BITS)
    return F.shiftleft(F.crc32(text.cast("binary")), 31) + F.shiftleft(low, SALT_BITS) + salt


@dataclass
class _Boundary:
    """A splitter in the making: the wanted measure below it, and the cell that holds it."""

    want: float
    tolerance: float
    measure: str
    key: int | None = None


def splitters(rows: DataFrame, wanted: list[_Boundary]) -> list[int]:
    """Keys such that `want` of the measure lies below, within the tolerance; rows: key, size, one.

    A round counts the cells that still matter in one aggregation.
    """
    cells, shift = {0: (0, KEY_BITS, {b.measure: 0 for b in wanted})}, KEY_BITS
    where: dict[int, list[_Boundary]] = {0: list(wanted)}
    below = {0: {"size": 0, "one": 0}}
    while where and shift > 0:
        step = min(CELL_BITS, shift)
        shift -= step
        cell = F.shiftright("key", shift)
        inside = rows if 0 in where and shift == KEY_BITS - step else rows.where(F.shiftright("key", shift + step).isin(list(where)))
        counts = inside.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.sum("one").alias("one")).collect()  # at most CELLS a boundary
        by_parent: dict[int, list] = {}
        for r in counts:
            by_parent.setdefault(r.cell >> step, []).append(r)
        after: dict[int, list[_Boundary]] = {}
        below_after = {}
        for parent, boundaries in where.items():
            found = sorted(by_parent.get(parent, []), key=lambda r: r.cell)
            sums = {m: [below[parent][m]] for m in ("size", "one")}
            for r in found:
                for m in sums:
                    sums[m].append(sums[m][-1] + r[m])
            for b in boundaries:
                at = sums[b.measure]
                k = min(max(bisect_left(at, b.want), 1), len(found)) if found else 0
                if not found:
                    b.key = parent << (shift + step)
                elif abs(at[k] - b.want) <= b.tolerance or (shift == 0 and at[k] - b.want <= b.want - at[k - 1]):
                    b.key = (found[k - 1].cell + 1) << shift
                elif abs(at[k - 1] - b.want) <= b.tolerance or shift == 0:
                    b.key = found[k - 1].cell << shift
                else:
                    after.setdefault(found[k - 1].cell, []).append(b)
                    below_after[found[k - 1].cell] = {m: sums[m][k - 1] for m in sums}
        where, below = after, below_after
    return [b.key for b in wanted]


def _interval(keys: list[int], key: Column, low: int = 0) -> Column:
    """The number of splitters at or below the key, by a balanced tree of comparisons."""
    if not keys:
        return F.lit(low)
    mid = len(keys) // 2
    return F.when(key < keys[mid], _interval(keys[:mid], key, low)).otherwise(_interval(keys[mid + 1 :], key, low + mid + 1))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, ranges: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, doc) of each row, as read from the shards; slot counts from 0 in key order within its shard.

    doc is the whole row.
    """
    text = F.coalesce("text", F.lit(""))
    rows = saved(docs.select(_size(text), sort_key(text, F.col("doc_id")).alias("key"), F.lit(1).cast("bigint").alias("one")), "keys")
    bytes_, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges or min(MOST_RANGES, max(RANGES, bytes_ // RANGE_BYTES))
    even = [_Boundary(bytes_ * k / shards, bytes_ / shards * tolerance, "size") for k in range(1, shards)]
    tasks = [_Boundary(count * k / ranges, count / ranges * RANGE_TOLERANCE, "one") for k in range(1, ranges)]
    keys = splitters(rows, even + tasks)
    cut, fine = sorted(keys[: shards - 1]), sorted(set(keys[shards - 1 :]))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), sort_key(text, F.col("doc_id")).alias("key"))
    placed = keyed.select("doc", "key", _interval(cut, F.col("key")).cast("int").alias("shard"), _interval(fine, F.col("key")).cast("int").alias("range"))
    order = [F.shiftright("key", SALT_BITS), F.col("doc.doc_id").asc_nulls_first(), F.col("key")]
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy(*order)).cast("bigint") - 1
    moved = _written(placed.withColumn("within", within).drop("key"))

    counts = moved.groupBy("shard", "range").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "range", F.coalesce(before, F.lit(0)).alias("offset"))  # at most ranges + shards rows
    text = F.coalesce("doc.text", F.lit(""))
    numbered = moved.join(F.broadcast(offsets), ["shard", "range"])
    return numbered.select("doc.doc_id", _size(text), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", (F.col("offset") + F.col("within")).alias("slot"), "doc")


def _size(text: Column) -> Column:
    return (F.octet_length(text).cast("bigint") + 1).alias("size")


def _written(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder, one folder per shard, and read again."""
    path = fresh_path(rows.sparkSession, "shards")
    write(rows, path, "shard")
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """What `shard` placed of docs as one folder per shard, in slot order within files; each row once, whatever its doc_id."""
    shard_, slot = fresh_name(docs, "shard"), fresh_name(docs, "slot")
    rows = placed.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(shard_), F.col("slot").alias(slot))
    rows.repartition(shard_, F.floor(F.col(slot) / 100_000)).sortWithinPartitions(shard_, slot).write.partitionBy(shard_).parquet(path)
