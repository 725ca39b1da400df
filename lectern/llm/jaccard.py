"""N-gram Jaccard join with Bayesian candidate pruning.

Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are
linked. The steps:

1. Each text gets MinHash values, computed in tasks; texts with equal shingle sets fold into
   one representative, counted and kept as members.
2. Representatives that agree in a whole band of values fall into one bucket. Buckets of equal
   content count once. A bucket is cut into blocks that are compared each within itself; then
   rows of different groups meet across blocks, so no task sees more than two blocks of rows,
   however large the bucket.
3. In a task, pairs compare their values a few at a time. After each step the posterior
   probability that the similarity reaches the threshold (uniform prior) decides: pairs below
   the tolerance are dropped. What remains leaves the task as edges that connect it, not as pairs.
4. The connected groups are cut into blocks and every two blocks meet in one task, so each surviving
   pair meets once, however many buckets proposed it. Pairs go through their values as before, and the
   shingle sets of those that survive, and of no others, are intersected exactly. Each document gets its
   number of links and a spanning forest of true links; their connected groups are the classes.

A link can be missed only if no band agrees (probability 5e-8 at similarity 0.8, less above)
or the posterior falls below the tolerance.

Edge cases: a text of one to four words has one shingle of all its words; a text with no word but
some other character has one shingle, itself; null and empty texts have none and are linked to
nothing, so each is a class of its own. Repeated rows with one doc_id are separate members of one
class and count as links of each other. A null doc_id keeps its row; it is never a class id while
another member has an id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.batches import fresh_name, in_tasks, saved, slices, with_columns
from lectern.llm.components import connected
from lectern.llm.words import mixed, shingles_of

SHINGLE_WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_VALUES = 32, 4
#: Values compared between two looks at the posterior, and the posterior below which a pair goes.
STEP_VALUES, TOLERANCE = 16, 1e-4
#: Rows of a block, and bytes of its shingle sets, about; a task's group holds two blocks.
BLOCK_ROWS, BLOCK_BYTES = 256, 16 << 20
#: Groups of several blocks whose sizes are sent to every task at most; more are joined by key.
LARGE_GROUPS = 500_000

VALUES = BANDS * BAND_VALUES
_SEEDS = mixed(np.arange(1, VALUES + 1, dtype=np.uint64))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles, offsets by text)."""
    shingles, offsets = shingles_of(texts, SHINGLE_WORDS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    counts = np.bincount(text[new], minlength=len(offsets) - 1)
    return shingles[new], np.concatenate(([0], np.cumsum(counts)))


def min_hashes(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 32-bit values per text that has a shingle."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), VALUES), np.uint32)
    if len(starts):
        for k, seed in enumerate(_SEEDS):
            x = (shingles ^ seed) * np.uint64(0x9E3779B97F4A7C15)
            out[:, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, rep, values) of documents with a shingle; rep is a 128-bit hash of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, at = shingle_sets(part.column("text"))
                full = np.flatnonzero(np.diff(at) > 0)
                if not len(full):
                    continue
                starts = at[:-1][full]
                high = np.add.reduceat(mixed(sets), starts)
                low = np.bitwise_xor.reduceat(mixed(sets + np.uint64(0x5851F42D4C957F2D)), starts) ^ np.diff(at)[full].astype(np.uint64)
                rep = pa.array([a.tobytes() + b.tobytes() for a, b in zip(high, low)], pa.binary())
                values = pa.array([v.tobytes() for v in min_hashes(sets, at)], pa.binary())
                own = part.select(["doc_id", "text_hash"]).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([*own.columns, rep, values], names=["doc_id", "text_hash", "rep", "values"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return in_tasks(rows, run, "doc_id long, text_hash long, rep binary, values binary")


@lru_cache(64)
def least_agreement(n: int) -> int:
    """The fewest agreeing values of n with which P(similarity >= THRESHOLD | agreement) reaches TOLERANCE.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at t is the chance of
    at most m successes in n + 1 trials of probability t.
    """
    t, tail = THRESHOLD, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= TOLERANCE:
            return m
    return n


def surviving_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of the two value tables that are not dropped on the way through the values."""
    agree = np.zeros((len(left), len(right)), np.int16)
    for k in range(STEP_VALUES):
        agree += left[:, k, None] == right[None, :, k]
    i, j = np.nonzero(agree >= least_agreement(STEP_VALUES))
    count = agree[i, j].astype(np.int64)
    for done in range(STEP_VALUES, VALUES, STEP_VALUES):
        count += (left[i, done : done + STEP_VALUES] == right[j, done : done + STEP_VALUES]).sum(axis=1)
        keep = count >= least_agreement(done + STEP_VALUES)
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def roots(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Of each of n rows, the least row that pairs connect it to; `root`: what is connected already."""
    root = np.arange(n) if root is None else root.copy()
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def in_blocks(rows: DataFrame, size: str, bytes_: str, member: str) -> DataFrame:
    """rows dealt to (lo, hi) for every two blocks of their group: a row meets each other row of its group once.

    Adds `mine`, the row's own block. Groups of up to BLOCK_ROWS rows and BLOCK_BYTES bytes, or of null size, are one block.
    """
    n = F.coalesce(F.greatest(F.ceil(F.col(size) / BLOCK_ROWS), F.ceil(F.col(bytes_) / BLOCK_BYTES)), F.lit(1)).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(member, F.lit(7)), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}).drop("other")


def _bucket_members(reps: DataFrame) -> DataFrame:
    """(bucket, n, rep) of the buckets with several representatives; of buckets with equal content, one."""
    band = BAND_VALUES * 4
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("values"), k * band + 1, F.lit(band))))
    keyed = reps.select("rep", F.explode(bands).alias("bucket"))
    print_ = F.xxhash64("rep")
    content = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(print_.cast("decimal(20,0)")).alias("s"), F.bit_xor(print_).alias("x")).where("n > 1")
    kept = content.groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return keyed.join(kept, "bucket")


def _block(salt: str, size: str) -> Column:
    """A row's block of its group: as many blocks as `size` rows need."""
    return F.pmod(F.xxhash64("rep", salt), F.ceil(F.col(size) / BLOCK_ROWS)).cast("int")


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b): edges that connect the pairs which the bands propose and the posterior keeps; reps: rep, values.

    First every bucket is compared within blocks, dealt anew in each bucket. That connects nearly all of what
    belongs together, large groups too. Then only pairs of rows from different groups are open: of the buckets
    that are larger than a block and hold several groups, all rows outside the largest group meet all rows.
    """
    members = saved(_bucket_members(reps), "buckets")
    values = reps.select("rep", "values")

    def table(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return rows.column("rep").to_numpy(), np.frombuffer(b"".join(rows.column("values").to_pylist()), np.uint32).reshape(-1, VALUES)

    def within(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        rep, own = table(rows)
        root = roots(len(rep), *surviving_pairs(own, own))
        member = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(rep[member], pa.binary()), "b": pa.array(rep[root[member]], pa.binary())})

    dealt = members.withColumn("block", _block("bucket", "n")).join(values, "rep").select("bucket", "block", "rep", "values")
    near = saved(dealt.groupBy("bucket", "block").applyInArrow(within, "a binary, b binary").distinct(), "near")
    large = members.where(F.col("n") > BLOCK_ROWS)
    if not large.head(1):
        return near

    groups = connected(near).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    large = saved(large.join(groups, "rep", "left").withColumn("group", F.coalesce("group", "rep")), "large")
    sizes = large.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "group")).alias("top"), F.sum("k").alias("all"))
    open_ = largest.select("bucket", F.col("top.group").alias("top"), (F.col("all") - F.col("top.k")).alias("others")).where("others > 0")
    rows = large.join(open_, "bucket").withColumns({"member_block": _block("bucket", "n"), "other_block": _block("bucket", "others")})
    blocks = lambda size: F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / BLOCK_ROWS).cast("int") - 1))
    columns = ["bucket", "other_block", "member_block", "side", "group", "rep"]
    left = rows.where("group <> top").withColumns({"member_block": blocks("n"), "side": F.lit(0)})
    right = rows.withColumns({"other_block": blocks("others"), "side": F.lit(1)})
    dealt = left.select(*columns).unionByName(right.select(*columns)).join(values, "rep")

    def across(rows: pa.Table) -> pa.Table:
        rep, own = table(rows)
        side, group = rows.column("side").to_numpy(), rows.column("group").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = surviving_pairs(own[left], own[right])
        i, j = left[i], right[j]
        differ = group[i] != group[j]
        _, number = np.unique(group, return_inverse=True)
        _, first = np.unique(number[i[differ]] * len(rep) + number[j[differ]], return_index=True)  # one edge between two groups
        return pa.table({"a": pa.array(rep[i[differ]][first], pa.binary()), "b": pa.array(rep[j[differ]][first], pa.binary())})

    far = dealt.groupBy("bucket", "other_block", "member_block").applyInArrow(across, "a binary, b binary")
    return near.unionByName(far).distinct()


def common_counts(flat: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of each pair (i, j); set n is flat[at[n] : at[n + 1]]."""
    _, column = np.unique(flat, return_inverse=True)
    has = np.zeros(len(flat), bool)
    out = np.zeros(len(i), np.int64)
    order = np.argsort(i, kind="stable")
    ends = np.flatnonzero(np.diff(np.append(i[order], -1)))
    for own in np.split(order, ends[:-1] + 1) if len(order) else []:
        k, others = i[own[0]], j[own]
        mine = column[at[k] : at[k + 1]]
        has[mine] = True
        sizes = at[others + 1] - at[others]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(at[others] - ends + sizes, sizes)
        out[own] = np.add.reduceat(has[column[place]], ends - sizes, dtype=np.int64)
        has[mine] = False
    return out


def true_links(flat: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs of sets, those whose similarity is THRESHOLD or more, as a mask."""
    sizes, common = np.diff(at), common_counts(flat, at, i, j)
    return common >= THRESHOLD * (sizes[i] + sizes[j] - common) - 1e-6


def verified(mine: np.ndarray, copies: np.ndarray, values: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(linked documents of each row, another row that links connect it to or itself) of one block's rows, or of two blocks'.

    Only pairs that survive the posterior are intersected. Where two blocks meet, pairs within either count where that block meets
    itself; here some of their links, one for a row at most, tell what is connected already, so that few connections come out.
    """
    blocks = [np.flatnonzero(mine == k) for k in np.unique(mine)]
    within = []
    for rows in blocks:
        i, j = surviving_pairs(values[rows], values[rows])
        within.append((rows[i[i < j]], rows[j[i < j]]))
    i, j = (np.concatenate(x) for x in zip(*within))
    before = np.arange(len(mine))
    if len(blocks) == 2:
        _, first = np.unique(j, return_index=True)
        i, j = i[first], j[first]
        known = true_links(flat, at, i, j)
        before = roots(len(mine), i[known], j[known])
        i, j = surviving_pairs(values[blocks[0]], values[blocks[1]])
        i, j = blocks[0][i], blocks[1][j]
    linked = true_links(flat, at, i, j)
    i, j = i[linked], j[linked]
    links = np.bincount(i, copies[j], len(mine)) + np.bincount(j, copies[i], len(mine))
    after = roots(len(mine), i, j, before)
    return links.astype(np.int64), np.where(before == np.arange(len(mine)), after, np.arange(len(mine)))


def exact_links(groups: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, links, to): counts of linked documents, in parts, and edges of a spanning forest of true links.

    groups: rep, group, which every surviving pair has in common. A text's shingle set is made once and goes to where its block meets another.
    """
    holders = groups.join(reps.select("rep", "copies", "values", "holder.doc_id", "holder.text_hash"), "rep").withColumnRenamed("doc_id", "holder")
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    same = (F.col("holder").eqNullSafe(F.col("doc_id"))) & (holders["text_hash"] == texts["text_hash"])
    one = lambda c: F.first(c).alias(c)
    rows = texts.join(holders, same).groupBy("rep").agg(*[one(c) for c in ("group", "copies", "values", "text")])

    def shingled(texts: pa.Array) -> list:
        flat, at = shingle_sets(texts)
        return [pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())]

    sets = saved(with_columns(rows, "text", [T.StructField("shingles", T.BinaryType())], lambda: shingled, drop=True), "sets")
    sizes = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    large = saved(sizes.where((F.col("n") > BLOCK_ROWS) | (F.col("bytes") > BLOCK_BYTES)), "large")
    large = F.broadcast(large) if large.limit(LARGE_GROUPS + 1).count() <= LARGE_GROUPS else large
    # Dealt by the blocks' numbers too: a large group's blocks are to be many tasks.
    dealt = in_blocks(sets.join(large, "group", "left"), "n", "bytes", "rep").repartition("group", "lo", "hi")

    def verify(rows: pa.Table) -> pa.Table:
        rep, mine, copies = (rows.column(c).to_numpy() for c in ("rep", "mine", "copies"))
        values = np.frombuffer(b"".join(rows.column("values").to_pylist()), np.uint32).reshape(-1, VALUES)
        found = rows.column("shingles").to_pylist()
        at = np.concatenate(([0], np.cumsum([len(x) // 8 for x in found])))
        links, to = verified(mine, copies, values, np.frombuffer(b"".join(found), np.uint64), at)
        return pa.table({"rep": pa.array(rep, pa.binary()), "links": pa.array(links, pa.int64()), "to": pa.array(rep[to], pa.binary())})

    columns = ["group", "lo", "hi", "mine", "rep", "copies", "values", "shingles"]
    return dealt.select(*columns).groupBy("group", "lo", "hi").applyInArrow(verify, "rep binary, links long, to binary")


def _members(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, component, class_id, n_links, copies) of each row of docs with a shingle."""
    each = saved(signatures(docs), "signatures")
    holder = F.min(F.struct("doc_id", "text_hash")).alias("holder")
    reps = saved(each.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"), holder, F.min("doc_id").alias("lowest"), F.first("values").alias("values")), "representatives")
    groups = saved(connected(candidate_edges(reps)).select(F.col("node").alias("rep"), F.col("component").alias("group")), "groups")
    checked = saved(exact_links(groups, reps, docs), "links")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected(checked.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    named = reps.select("rep", "copies", "lowest").join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    lowest = named.groupBy("component").agg(F.min("lowest").alias("class_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    named = saved(named.join(lowest, "component").select("rep", "component", "class_id", n_links.alias("n_links"), "copies"), "classes")
    return each.select("doc_id", "text_hash", "rep").join(named, "rep").drop("rep")


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _empty():
    return F.coalesce("text", F.lit("")) == ""


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, copies) of each row of docs (doc_id, text).

    class_id is the lowest doc_id of the documents that links connect; n_links counts the other documents with a
    similarity of THRESHOLD or more, copies included; copies counts the documents with the same shingle set, itself included.
    """
    docs = _ids_and_texts(docs)
    alone = docs.where(_empty()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return _members(docs).select("doc_id", "class_id", "n_links", "copies").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, of each class only the one of the lowest doc_id (then text hash); rows equal in both count as one."""
    key = ["doc_id", "text_hash"]
    first = F.min(F.struct(F.col("doc_id").isNull(), *key)).alias("first")
    kept = _members(_ids_and_texts(docs)).groupBy("component").agg(first).select("first.doc_id", "first.text_hash")
    alone = docs.where(_empty()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    name, id_, hash_ = (fresh_name(docs, x) for x in ("text_hash", "kept_id", "kept_hash"))
    kept = kept.unionByName(alone).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(name) == F.col(hash_))
    return docs.withColumn(name, F.xxhash64("text")).join(kept, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
