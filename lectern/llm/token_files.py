"""Token-id files with keyed access through a minimal perfect hash.

The format is two Parquet tables. `blocks` holds the ids, in ascending doc_id order. A block has

    part, seq     its place; blocks in (part, seq) order hold the documents in doc_id order
    nulls         rows without doc_id, which come first of all
    width         bytes per id, 2 or 4, little-endian
    n_ids         ids in the block
    keys          doc_ids of the other rows, 64-bit, ascending
    at            of each row, its first id in the payload, and the end
    payload       all ids, nothing else

`index` leads from a key to its place. Keys are dealt to buckets by their hash, about BUCKET_KEYS to each,
and each bucket is a minimal perfect hash of its keys:

    bucket, buckets   its number, and how many there are
    pilots            of each group of keys, the pilot that sends them to free slots
    prints            of each slot, the key's 32-bit fingerprint
    firsts            of each slot, its first place in the lists that follow, and the end
    part, seq, row    block and first row
    rows              rows from there on that have the key

A key's bucket follows from its hash, its slot from its hash and a pilot: as many slots as keys, no two keys
in one slot. The fingerprint turns away keys that no file has, but for one in 2 ** 32, which the block's own
keys then turn away. So access reads one bucket, one slot and one run of ids, however many documents there
are. Asked keys meet their buckets by an equi-join, and places their blocks by another; of the blocks, only
files and row groups that hold a place are read, if these are few.

Files are written by Spark's own committer into the shared folder, so a lost executor costs only its
running tasks. Texts are moved once, by range of doc_id and then of text hash, so that one doc_id with
very many rows is spread too; the index has one entry for each block that holds a key.

Edge cases: null reads as empty text, which has the end id alone; rows without doc_id are kept
and listed but have no key; rows that share a doc_id follow each other by text hash and one key
finds them all; an empty table gives no block; columns besides doc_id and text are not read; doc_ids of
another type are cast to 64-bit integers, as asked keys are.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from lectern.llm.batches import in_tasks, kept, saved, slices
from lectern.llm.batches import write as store
from lectern.llm.bpe import KEPT_CHARACTERS, byte_letters, check_vocabulary
from lectern.llm.words import mixed
from lectern.sources.shared import fresh_path

#: A block ends after so many ids or rows.
BLOCK_IDS, BLOCK_ROWS = 1 << 20, 4096
END_ID = 0
#: Fixed value: the pattern by which byte-level vocabularies of this kind split a text.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_RUNS = re.compile(r"\s (?!\S)")
_DOUBLE = [c + " " for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"]
_SIGNS = frozenset(",.;:!?")
_LETTERS = byte_letters()
_LATIN = {c: "".join([_LETTERS[b] for b in chr(c).encode()]) for c in range(0x250) if c >= 128 or _LETTERS[c] != chr(c)}
_BEYOND_LATIN = re.compile("[\x1c-\x1f]|[^\x00-\u024f]")
KEYS_PER_BUCKET = 4
#: Keys of an index bucket, about.
BUCKET_KEYS = 4096
#: Up to so many files hold a lookup's blocks, their numbers go to the scan as a filter.
FILES = 1000
#: Bytes of a row group of blocks: what a scan skips or reads as a whole.
GROUP_BYTES = 8 << 20

BLOCK = "part int, seq int, nulls long, width int, n_ids long, keys binary, at binary, payload binary"
INDEX = "bucket long, buckets long, pilots binary, prints binary, firsts binary, part binary, seq binary, row binary, rows binary"


class Learned(dict):
    """A bounded dictionary that makes what it lacks; what was not asked for during a whole turn goes."""

    def __init__(self, make, most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_CHARACTERS and "\n" not in key:  # others hardly come twice
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()


class Encoder:
    """The tokenizers library on pieces of text, each distinct piece once while it is remembered.

    A piece starts at a blank and holds no other. The file's pattern never joins a blank with what
    stands before it, except in runs of white space; texts with such runs, or with the name of a
    special token, go to the library whole. A new piece is cut into pre-tokens as the library does,
    and of these only new ones are put through the library's merges.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        with open(path, encoding="utf-8") as f:
            check_vocabulary(json.load(f), {"normalizer": None, "pre_tokenizer": _BYTE_LEVEL, "post_processor": None})
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        model = self.library.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # it is asked for each word once
        self.merge = model.tokenize
        # What was learned of pieces without a blank in front, with one, and of pre-tokens.
        self.heads, self.pieces, self.parts = Learned(self._piece, 150_000), Learned(lambda x: self._piece(" " + x), 600_000), Learned(self._ids, 150_000)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _ids(self, part: str) -> bytes:
        """Ids of one pre-token in byte letters."""
        tokens = self.merge(part)
        return struct.pack(f"<{len(tokens)}{self.code}", *[t.id for t in tokens])

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece. Letters alone, after a blank or not, are one pre-token; a sign behind them is another."""
        known, word = (self.pieces, piece[1:]) if piece[0] == " " else (self.heads, piece)
        if "\n" in word:
            lines = word.split("\n")
            if all(lines) and not any(x[0].isspace() or x[-1].isspace() for x in lines):  # a line break alone is a pre-token
                return known[lines[0]] + b"".join([self.parts["Ċ"] + self.heads[x] for x in lines[1:]])
        plain = piece.isascii()
        if plain or not _BEYOND_LATIN.search(piece):
            if word.isalpha():
                part = word if plain else word.translate(_LATIN)
                return self._ids("Ġ" + part if known is self.pieces else part)
            if word[-1:] in _SIGNS and word[:-1].isalpha():
                return known[word[:-1]] + self.parts[word[-1]]
        return b"".join([self.parts[part] for part in self._parts(piece)])

    def _parts(self, piece: str) -> list[str]:
        """Pre-tokens in byte letters; the library's own way for what is not plain Latin."""
        if piece.isascii() and piece.isprintable():
            return ["Ġ" + part[1:] if part[0] == " " else part for part in _PATTERN.findall(piece)]
        if _BEYOND_LATIN.search(piece):
            return [part for part, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        return [part.translate(_LATIN) for part in _PATTERN.findall(piece)]

    def _runs(self, text: str) -> bool:
        """Whether some blank has white space before it and white space or the end behind it."""
        if text.isascii() and not any(x in text for x in _DOUBLE) and text[-1:] != " ":
            return False
        return _RUNS.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at = [], []
        heads, rest = self.heads, self.pieces.__getitem__
        for text in texts:
            if self._runs(text) or any(x in text for x in self.special):
                at.append(len(out))
                out.append(text)
            else:
                pieces = text.split(" ")
                first = heads[pieces[0]] if pieces[0] else b""
                out.append(first + b"".join(map(rest, islice(pieces, 1, None))))
        for k, x in zip(at, self.library.encode_batch([out[k] for k in at], add_special_tokens=False)):
            out[k] = np.array(x.ids, self.dtype).tobytes()
        for known in (self.heads, self.pieces, self.parts):
            known.turn()
        return out


def encoder(path: str) -> Encoder:
    return kept(f"pieces {path}", lambda: Encoder(path))


def _hash(keys: np.ndarray) -> np.ndarray:
    return mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _slot(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (mixed(hashes ^ mixed(pilots.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pilots, prints, slots) of distinct keys: buckets from the largest on try pilots until all their keys fall on free slots."""
    n = len(keys)
    hashes = _hash(keys)
    n_buckets = -(-n // KEYS_PER_BUCKET)
    bucket = (hashes >> np.uint64(32)) % np.uint64(max(n_buckets, 1))
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket.astype(np.int64), minlength=n_buckets)
    ends = np.cumsum(sizes)
    pilots, slots, free = np.zeros(n_buckets, np.uint32), np.zeros(n, np.uint32), np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        members = order[ends[b] - sizes[b] : ends[b]]
        tried, step = 0, 64
        while True:
            trial = np.arange(tried, tried + step, dtype=np.uint32)
            places = _slot(hashes[members][None, :], trial[:, None], n)
            ok = free[places].all(axis=1)
            if len(members) > 1:
                ranked = np.sort(places, axis=1)
                ok &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if ok.any():
                k = int(np.argmax(ok))
                pilots[b] = trial[k]
                free[places[k]] = False
                slots[places[k]] = members
                break
            tried, step = tried + step, min(step * 2, 4096)
    prints = (hashes[slots] & np.uint64(0xFFFFFFFF)).astype("<u4")
    return pilots, prints, slots


def find(keys: np.ndarray, pilots: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Of each key its slot, or -1 if another fingerprint is there."""
    if not len(prints):
        return np.full(len(keys), -1)
    hashes = _hash(keys)
    slot = _slot(hashes, pilots[(hashes >> np.uint64(32)) % np.uint64(len(pilots))], len(prints))
    return np.where(prints[slot] == (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), slot, -1)


class Block:
    """Ids of a block's rows by their places."""

    def __init__(self, row: dict):
        ints = lambda name, kind: np.frombuffer(row[name], kind)
        self.part, self.seq, self.nulls = row["part"], row["seq"], row["nulls"]
        self.keys, self.at = ints("keys", "<i8"), ints("at", "<i8")
        self.payload = ints("payload", "<u2" if row["width"] == 2 else "<u4")

    def key(self, row: int) -> int | None:
        return None if row < self.nulls else int(self.keys[row - self.nulls])

    def ids(self, row: int) -> np.ndarray:
        return self.payload[self.at[row] : self.at[row + 1]]


def _block(part: int, seq: int, doc_ids: list, ids: list[bytes], dtype: np.dtype) -> dict:
    nulls = sum(d is None for d in doc_ids)
    at = np.concatenate(([0], np.cumsum([len(x) // dtype.itemsize for x in ids]))).astype("<i8")
    return {
        "part": part, "seq": seq, "nulls": nulls, "width": dtype.itemsize, "n_ids": int(at[-1]),
        "keys": np.array(doc_ids[nulls:], "<i8").tobytes(), "at": at.tobytes(), "payload": b"".join(ids),
    }


def write(docs: DataFrame, tokenizer: str, path: str | None = None) -> str:
    """Encodes docs (doc_id, text) into the file format at `path`, by default a new folder in the shared one; returns it."""
    path = path or fresh_path(docs.sparkSession, "tokens")
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = encoder(tokenizer), None
        part, seq, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([END_ID], own.dtype).tobytes()
        schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in BLOCK.split(","))])
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                found = own.encode([t or "" for t in piece.column("text").to_pylist()])
                for doc_id, x in zip(piece.column("doc_id").to_pylist(), found):
                    doc_ids.append(doc_id)
                    ids.append(x + end)
                    size += len(ids[-1])
                    if size >= BLOCK_IDS * own.dtype.itemsize or len(ids) >= BLOCK_ROWS:
                        yield pa.RecordBatch.from_pylist([_block(part, seq, doc_ids, ids, own.dtype)], schema)
                        seq, doc_ids, ids, size = seq + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(part, seq, doc_ids, ids, own.dtype)], schema)

    store(in_tasks(ordered, run, BLOCK, keeps=True), f"{path}/blocks", compression="snappy", **{"parquet.block.size": GROUP_BYTES})
    _write_index(docs.sparkSession, path)
    return path


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets).cast("bigint"))


def _write_index(spark: SparkSession, path: str) -> None:
    """The index of the blocks at `path`, made of their keys alone."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, first, rows = np.unique(np.frombuffer(row["keys"], "<i8"), return_index=True, return_counts=True)
                same = [pa.array(np.full(len(keys), row[c], np.int32)) for c in ("part", "seq")]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *same, pa.array((first + row["nulls"]).astype(np.int32)), pa.array(rows.astype(np.int32))], names=["doc_id", "part", "seq", "row", "rows"])

    def build(group: pa.Table) -> pa.Table:
        keys, which = np.unique(group.column("doc_id").to_numpy(), return_inverse=True)
        pilots, prints, slots = build_index(keys)
        slot_of = np.empty(len(keys), np.int64)
        slot_of[slots] = np.arange(len(keys))
        columns = {c: group.column(c).to_numpy() for c in ("part", "seq", "row", "rows")}
        order = np.lexsort((columns["seq"], columns["part"], slot_of[which]))
        firsts = np.concatenate(([0], np.cumsum(np.bincount(slot_of[which], minlength=len(keys))))).astype("<i4")
        values = {"pilots": pilots, "prints": prints, "firsts": firsts} | {c: x[order].astype("<i4") for c, x in columns.items()}
        return pa.table({"bucket": group.column("bucket")[:1], "buckets": pa.array([buckets], pa.int64())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in values.items()})

    rows = in_tasks(blocks(spark, path).select("part", "seq", "nulls", "keys"), places, "doc_id long, part int, seq int, row int, rows int")
    total = blocks(spark, path).agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    buckets = max(1, -(-total // BUCKET_KEYS))
    store(rows.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, INDEX), f"{path}/index")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, base): ids before each block. Running sums within parts, then over the few parts' totals."""
    sizes = blocks(spark, path).select("part", "seq", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_base"))
    within = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("own"))
    return within.join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("own")).alias("base"))


def _each(rows: DataFrame, wanted: str | None = None, digest: bool = False, only_nulls: bool = False) -> DataFrame:
    """(part, seq, row, doc_id, own, n_tokens, ids): rows of each block: all, those without doc_id, or those at the places in column `wanted`.

    With `digest`, ids_crc32 in place of ids: the checksum of the ids as little-endian unsigned 32-bit integers.
    """

    def places(row: dict, block: Block) -> list[int]:
        if wanted is None:
            return list(range(block.nulls if only_nulls else len(block.at) - 1))
        return [r for w in row[wanted] if block.key(w["row"]) == w["doc_id"] for r in range(w["row"], w["row"] + w["rows"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                listed = places(row, block)
                for i in range(0, len(listed), 256):
                    out = listed[i : i + 256]
                    found = [block.ids(r).astype("<u4") for r in out]
                    sizes = np.array([len(x) for x in found], np.int64)
                    if digest:
                        values = pa.array([zlib.crc32(x) for x in found], pa.int64())
                    else:
                        values = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(found).view(np.int32)))
                    place = [pa.array(np.full(len(out), x, np.int32)) for x in (block.part, block.seq)]
                    columns = [*place, pa.array(out, pa.int32()), pa.array([block.key(r) for r in out], pa.int64()), pa.array([int(block.at[r]) for r in out], pa.int64()), pa.array(sizes), values]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "ids_crc32 long" if digest else "ids array<int>"
    names = ["part", "seq", "row", "doc_id", "own", "n_tokens", kind.split()[0]]
    return in_tasks(rows, run, f"part int, seq int, row int, doc_id long, own long, n_tokens long, {kind}")


def read(spark: SparkSession, path: str, digest: bool = False, only_nulls: bool = False) -> DataFrame:
    """(part, seq, row, doc_id, own, n_tokens, ids or ids_crc32) of all documents, or those without doc_id; own counts the block's ids before the document."""
    rows = blocks(spark, path)
    return _each(rows.where("nulls > 0") if only_nulls else rows, digest=digest, only_nulls=only_nulls)


def places(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, part, seq, row, rows): where the index has the doc_ids in `keys`."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    buckets = index.select("buckets").first()

    def locate(asked: pa.Table, bucket: pa.Table) -> pa.Table:
        own = {c: np.frombuffer(bucket.column(c)[0].as_py() if bucket.num_rows else b"", kind) for c, kind in kinds.items()}
        keys = asked.column("doc_id").to_numpy()
        slot = find(keys, own["pilots"], own["prints"])
        keys, slot = keys[slot >= 0], slot[slot >= 0]
        n = np.diff(own["firsts"])[slot] if len(slot) else np.zeros(0, np.int64)
        at = np.repeat(own["firsts"][slot] - np.cumsum(n) + n, n) + np.arange(n.sum()) if len(slot) else np.zeros(0, np.int64)
        return pa.table({"doc_id": pa.array(np.repeat(keys, n)), **{c: pa.array(own[c][at]) for c in ("part", "seq", "row", "rows")}})

    kinds = {"pilots": "<u4", "prints": "<u4"} | dict.fromkeys(("firsts", "part", "seq", "row", "rows"), "<i4")
    keys = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("bucket", _bucket(buckets.buckets if buckets else 1))
    return keys.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(locate, "doc_id long, part int, seq int, row int, rows int")


def lookup(spark: SparkSession, path: str, keys: DataFrame, digest: bool = False) -> DataFrame:
    """What `read` gives, for the doc_ids in `keys` alone; ids that no file holds give no row.

    Places meet their blocks, and of each block only the rows at these places are read (and digested, with `digest`). The block's own key
    turns away what a fingerprint let through.
    """
    found = saved(places(spark, path, keys), "places")
    rows = blocks(spark, path)
    files = found.select("part").distinct().limit(FILES + 1).collect()
    if len(files) <= FILES:
        last = found.agg(F.min("seq"), F.max("seq")).first()
        rows = rows.where(F.col("part").isin([r.part for r in files])).where(F.col("seq").between(*last)) if files else rows.where("false")
    wanted = found.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "row", "rows")).alias("wanted"))  # at most a block's rows
    return _each(rows.join(wanted.hint("shuffle_hash"), ["part", "seq"]), "wanted", digest)
