"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors.

A text's one- to three-byte n-grams of its letters (lower case, words set apart) are hashed into a
fixed number of dimensions, counts damped by a logarithm, weighted by inverse document frequency
and set to length one. Each language has several centroids, found by spherical k-means, for texts
of one language differ in kind. The nearest centroid by cosine names the language; a text farther
from it than nearly all training texts of that language were is marked as rejected.

Document frequencies count all training documents; centroids are fitted on a bounded sample of each
language, drawn by the rows' hashes.

Edge cases: null texts and texts without a letter are `und`, score 0, rejected; null languages are
not learned from; with no training document at all every text is `und`. A third of all rows may have
one language: only its bounded sample meets in one task; so too if a third are one repeated row, as each
repeat is drawn by itself. Other columns pass through; a new column whose name is taken gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.batches import in_tasks, saved, slices, with_columns
from lectern.llm.words import buffers

DIMENSIONS = 1 << 12
SIZES = (1, 2, 3)
CENTROIDS, ROUNDS = 4, 12
#: Training documents of a language that its centroids are fitted on.
SAMPLE = 1500
#: A text is rejected if its cosine is lower than this share of the language's training texts had.
REJECTED_SHARE = 0.005
#: Up to so many languages, their sizes are sent to every task.
MANY = 10_000
#: Texts whose vectors are made at once.
ROWS = 128
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def counts(texts: pa.Array) -> np.ndarray:
    """n-gram counts, one row per text. Runs of other characters than letters count as one blank."""
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}]+", " ")
    data, at = buffers(low)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.zeros(len(texts) * DIMENSIONS, np.int64)
    for size in SIZES:
        if len(data) < size:
            continue
        code = np.full(len(data) - size + 1, size, np.uint64)
        for j in range(size):
            code = code << np.uint64(8) | data[j : len(data) - size + 1 + j]
        same = text[: len(code)] == text[size - 1 :]
        bucket = ((code * _MIX) >> np.uint64(65 - DIMENSIONS.bit_length())).astype(np.int64)
        out += np.bincount((text[: len(code)] * DIMENSIONS + bucket)[same], minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        for start in range(0, part.num_rows, ROWS):
            yield part.slice(start, ROWS)


@dataclass
class Languages:
    idf: np.ndarray
    names: list[str]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # of each centroid, the cosine below which a text is rejected

    def identify(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, cosines, rejected)."""
        lettered = has_letter(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        like = vectors(texts, self.idf) @ self.centroids.T
        best = like.argmax(axis=1)
        score = np.where(lettered, np.clip(like[np.arange(len(best)), best].astype(float), 0, 1), 0.0)
        return [self.names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered)], score, ~lettered | (score < self.least[best])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that have each dimension, documents); docs: text. Tasks send one number per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for part in rows_of(batch):
                total += (counts(part.column("text")) > 0).sum(axis=0)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMENSIONS), -1)), pa.array(np.append(total, n))], names=["dimension", "n"])

    rows = in_tasks(docs.select("text"), run, "dimension long, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS + 1
    found = {r.dimension: r.n for r in rows}
    return np.array([found.get(k, 0) for k in range(DIMENSIONS)]), found.get(-1, 0)


def sample(docs: DataFrame, most: int, many: int = MANY) -> DataFrame:
    """About `most` documents of each language, drawn by hash; docs: doc_id, text, lang. Fewer if there are fewer.

    A threshold for each language's hash lets through slightly more than are wanted, so no language has to be sorted. Of rows
    that agree in doc_id and text, as many are drawn as their number and their hash say: what is drawn depends on the rows
    alone, not on how they lie in partitions. Only hashes and counts are shuffled, and then the texts drawn.
    """
    sizes = saved(docs.groupBy("lang").count(), "languages")
    sizes = F.broadcast(sizes) if sizes.limit(many + 1).count() <= many else sizes
    share = F.least(F.lit(1.0), F.lit(1.2 * most) / F.col("count"))
    part = lambda x: F.pmod(x, F.lit(1 << 30)) / (1 << 30)
    hashed = docs.withColumns({"_a": F.xxhash64(F.lit(11), "doc_id", "text"), "_b": F.xxhash64(F.lit(12), "text", "doc_id")})
    equal = hashed.groupBy("lang", "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    drawn = equal.join(sizes, "lang").withColumn("_drawn", F.floor(F.col("_n") * share + part(F.col("_a")))).where("_drawn > 0")
    drawn = saved(drawn.select("lang", "_a", "_b", "_drawn"), "drawn")
    texts = hashed.join(drawn, ["lang", "_a", "_b"]).groupBy("lang", "_a", "_b", "_drawn").agg(F.min("text").alias("text"))
    each = texts.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_drawn")))
    return each.select("lang", part(F.xxhash64(F.lit(13), "_a", "_b", "_k")).alias("pick"), "text")


def _cluster(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Spherical k-means from spread-out starts; rows of length one."""
    start = [int(np.random.default_rng(seed).integers(len(x)))]
    near = x @ x[start[0]]
    while len(start) < min(CENTROIDS, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def fit(docs: DataFrame) -> Languages:
    """docs: doc_id, text, lang; leave held-out documents out."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    df, n = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    chosen = saved(sample(known, SAMPLE), "sample")

    def centroids(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("pick", "ascending"), ("text", "ascending")]).slice(0, SAMPLE).combine_chunks()
        texts = rows.column("text").combine_chunks()
        texts = texts.filter(pa.array(has_letter(texts)))
        if not len(texts):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.list_(pa.float32())), "least": pa.array([], pa.float64())})
        x = np.concatenate([vectors(texts.slice(a, ROWS), idf) for a in range(0, len(texts), ROWS)])
        c = _cluster(x)
        least = float(np.quantile((x @ c.T).max(axis=1), REJECTED_SHARE))
        return pa.table({"lang": [rows.column("lang")[0].as_py()] * len(c), "centroid": pa.array(list(c), pa.list_(pa.float32())), "least": [least] * len(c)})

    found = chosen.groupBy("lang").applyInArrow(centroids, "lang string, centroid array<float>, least double").orderBy("lang").collect()  # a few per language
    return Languages(idf, [r.lang for r in found], np.array([r.centroid for r in found], np.float32).reshape(-1, DIMENSIONS), np.array([r.least for r in found]))


def identify(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the cosine) and rejected."""

    def make():
        def compute(texts: pa.Array) -> list:
            parts = [model.identify(texts.slice(a, ROWS)) for a in range(0, len(texts), ROWS)]
            names = [n for p in parts for n in p[0]]
            return [pa.array(names, pa.string()), *[pa.array(np.concatenate([p[k] for p in parts]) if parts else []) for k in (1, 2)]]

        return compute

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return with_columns(docs, text, fields, make)
