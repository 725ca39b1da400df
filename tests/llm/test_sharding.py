import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import sharding

from .conftest import SCHEMA


def laws(rows, docs, shards):
    """Each row once, slots gapless, equal texts next to each other, bytes near equal."""
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    order = [r.text_crc32 for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert all(0 <= r.shard < shards for r in rows)
    return {s: sum(r.size for r in m) for s, m in by_shard.items()}


def test_odd_rows(odd_docs, odd_rows, no_docs):
    docs = odd_docs.withColumnRenamed("source", "key").withColumnRenamed("lang", "size")
    laws(sharding.shard(docs).collect(), [(r[0], r[1]) for r in odd_rows], 8)
    assert sharding.shard(no_docs).count() == 0


@pytest.mark.parametrize("shards, ranges", [(8, 256), (3, 4), (1, 1)])
def test_hot_group_is_cut(spark, shards, ranges):
    """A third of all rows share one text; shards stay equal in bytes to within a row and the tolerance."""
    docs = [(i, "same text " * 5 if i % 3 == 0 else f"text {i} " * (i % 11 + 1), None, None, None) for i in range(3000)]
    rows = sharding.shard(spark.createDataFrame(docs, SCHEMA).repartition(4), shards, ranges=ranges).collect()
    sums = laws(rows, [d[:2] for d in docs], shards)
    share = sum(sums.values()) / shards
    assert len(sums) == shards and all(abs(s - share) <= 2 * share * sharding.TOLERANCE + 2 * max(r.size for r in rows) for s in sums.values())


def test_one_giant(spark):
    docs = [(1, "x" * 100_000, None, None, None)] + [(i, "y", None, None, None) for i in range(2, 40)]
    laws(sharding.shard(spark.createDataFrame(docs, SCHEMA)).collect(), [d[:2] for d in docs], 8)


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "a", 1) for i in range(50)], SCHEMA)
    sharding.write_shards(docs, sharding.shard(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and set(docs.columns) <= set(back.columns) and back.select("shard").distinct().count() == 4


def test_rows_that_agree_are_cut_and_written_once(spark, tmp_path):
    """A third of all rows agree in text and doc_id, others have no doc_id; rows are told apart by n_chars."""
    docs = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "same text " * 5 if i % 3 == 0 else f"text {i % 50} " * (i % 11 + 1), "en", "a", i) for i in range(3000)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    placed = sharding.shard(df, 8)
    rows = placed.collect()
    sums = laws(rows, [d[:2] for d in docs], 8)
    share = sum(sums.values()) / 8
    # This input deals its rows anew when read again, so salts differ; one uncut group alone would be 2.8 shares.
    assert len(sums) == 8 and all(abs(s - share) <= 0.15 * share for s in sums.values())
    sharding.write_shards(df, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.n_chars for r in back) == list(range(3000))
    assert {(r.n_chars, r.text, r.doc_id) for r in back} == {(d[4], d[1], d[0]) for d in docs}
    assert {(r.n_chars, r.shard, r.slot) for r in back} == {(r.doc.n_chars, r.shard, r.slot) for r in rows}


def test_query(spark):
    from lectern.llm.registry import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op5_sharding"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    laws(rows, [tuple(d) for d in docs], 8)


def test_splitters_against_a_sort(spark):
    """Each splitter has the wanted bytes below it, to within the tolerance or the row that no key can cut, as in a plain sort of all keys."""
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 13 + 1)) for i in range(4000)], "doc_id bigint, text string").repartition(3)
    rows = docs.select(sharding._size(F.col("text")), sharding.sort_key(F.col("text"), F.col("doc_id")).alias("key"), F.lit(1).alias("one")).cache()
    plain = sorted((r.key, r.size) for r in rows.collect())
    total = sum(size for _, size in plain)
    wanted = [sharding._Boundary(total * k / 8, total / 8 * 0.001, "size") for k in range(1, 8)]
    for b, key in zip(wanted, sharding.splitters(rows, wanted)):
        below = sum(size for k, size in plain if k < key)
        assert abs(below - b.want) <= max(b.tolerance, max(size for _, size in plain))
    rows.unpersist()
