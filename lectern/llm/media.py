"""Media columns: FLAC streams in a binary column, and the PCM blocks in them.

Texts can be stored as sound: their UTF-8 bytes, filled up with blanks, are 8-bit samples of a FLAC
stream. A stream column decodes to PCM blocks: runs of frames of bounded size, each with the sample at
which it begins and the byte offset of its first frame, so that a player can seek to either. The blocks
are a column of their stream's row or rows of their own.

Edge cases: null and empty texts store one block of blanks; a null or damaged stream has no block
and an error; repeated rows get equal results; other columns pass through; a new column whose name is taken
gets underscores in front; nothing is shuffled. A stream is decoded as a whole, as its row is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import flac
from lectern.llm.batches import fresh_fields, in_tasks, slices, with_columns
from lectern.llm.words import buffers

#: Stream bytes that are decoded at once.
SLICE = 1 << 20
#: PCM bytes of a block, about; a frame is never cut.
BLOCK_BYTES = 1 << 16

BLOCK = "struct<first_sample: bigint, n_samples: bigint, byte_offset: bigint, pcm: binary>"
_ARROW = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary())]))


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a column of FLAC streams."""

    def make():
        def compute(texts: pa.Array) -> list:
            data, at = buffers(texts)
            raw = data.tobytes()
            payloads = [raw[a:b] + b" " * (-(b - a) % flac.BLOCK if b > a else flac.BLOCK) for a, b in zip(at.tolist(), at[1:].tolist())]
            return [pa.array(flac.encode(payloads), pa.binary())]

        return compute

    return with_columns(docs, text, [T.StructField(media, T.BinaryType())], make)


def feature(s: flac.Stream) -> str:
    """Level, crossings of the middle, and roughness of the first channel, in fixed digits."""
    x = s.samples[0]
    if not len(x):
        return "empty"
    rms = float(np.sqrt(np.mean(x.astype(float) ** 2)))
    crossings = float(np.mean((x[1:] >= 0) != (x[:-1] >= 0))) if len(x) > 1 else 0.0
    rough = float(np.mean(np.abs(np.diff(x)))) if len(x) > 1 else 0.0
    return f"rms={rms:.4f};zero={crossings:.6f};rough={rough:.4f};peak={int(np.abs(x).max())};blocks={len(s.blocks)}"


def blocks_of(s: flac.Stream) -> list[dict]:
    """PCM blocks of a decoded stream: its frames in runs of BLOCK_BYTES or one frame."""
    pcm, size, out = s.pcm(), s.channels * -(-s.bits // 8), []
    for first, n, offset in s.blocks:
        if out and (out[-1]["n_samples"] + n) * size <= BLOCK_BYTES:
            out[-1]["n_samples"] += n
        else:
            out.append({"first_sample": first, "n_samples": n, "byte_offset": offset})
    return [b | {"pcm": pcm[b["first_sample"] * size : (b["first_sample"] + b["n_samples"]) * size]} for b in out]


def with_pcm(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows with blocks (array of BLOCK), sample_rate, channels, bits, feature, error of each stream; the stored bytes are decoded and verified."""
    fields = T.StructType.fromDDL(f"blocks array<{BLOCK}>, sample_rate int, channels int, bits int, feature string, error string").fields
    schema = T.StructType([*rows.schema.fields, *fresh_fields(rows, fields)])
    kinds = [_ARROW, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, SLICE):
                found = flac.decode(part.column(media).to_pylist())
                out = [([], None, None, None, None, s.error) if s.error else (blocks_of(s), s.sample_rate, s.channels, s.bits, feature(s), None) for s in found]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=schema.names)

    return in_tasks(rows, run, schema)


def whole(blocks: Column) -> Column:
    """The samples of all blocks, in order."""
    in_order = F.array_sort(F.transform(blocks, lambda b: F.struct(b["first_sample"].alias("at"), F.hex(b["pcm"]).alias("hex"))))
    return F.unhex(F.array_join(F.transform(in_order, lambda b: b["hex"]), ""))


def pcm_blocks(rows: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, first_sample, n_samples, byte_offset, pcm): a row per block. Damaged streams have no row."""
    names = [key, media]
    found = with_pcm(rows.select(*names), media)
    return found.select(key, F.explode(found.columns[2]).alias("block")).select(key, "block.*")
