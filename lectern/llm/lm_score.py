"""Cross-entropy difference: two n-gram models over one vocabulary score each document.

Tokens are words (runs of letters and digits of the lower-cased text), known by hashes of 62 bits;
the vocabulary of both models is what the corpus has. The target model counts the target documents,
the background model all others. The models are matched: both are bigram models with the same smoothing,
and the counts of the one with more tokens are weighed down until both have as many, so that neither
is the surer for its size. No document is sampled away. With c the weighed counts and V the vocabulary,

    p(w)     = (c(w) + FLOOR) / (c(all words) + FLOOR * (V + 1))
    p(w | v) = (c(v w) + WEIGHT * p(w)) / (c(v) + WEIGHT)

where v may be the beginning of a text, which occurs once in each. A document's own occurrences are taken off the counts of
single words, beginnings and pairs before it is scored, so no model has seen what it scores; copies in other rows stay counted.
The score is the mean over the document's tokens of the target's loss less the background's, in
bits: lower is nearer to the target.

Everything is a distributed table, at every size. Rows are written in blocks of bounded text, and each
block lists its distinct words and pairs once. The lists meet by word or pair, which gives the models'
counts, and what several blocks have goes back to each of them, to the task that scores its documents; what
only one block has, that task counts itself. So words and pairs move once a block, not once a document, and
none is hot: a block lists each once.

Edge cases: null, empty and wordless texts have no token and null scores; with no target document, or
none besides, that model is uniform; repeated rows count as often as they occur and get equal scores; a
null doc_id is no target; documents that the models have not counted are scored with all counts, new
words as the unknown one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.batches import in_tasks, saved, slices
from lectern.llm.words import mixed, words_of

#: What a context's count is weighed against, and the smoothing of single words.
WEIGHT, FLOOR = 8.0, 0.5
#: Text of a block, whose distinct words and pairs are listed once; one longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Blocks are scored in so many turns, which limits the disk that shuffles take at one time.
TURNS = 3
#: Partitions of a shuffle at most; beyond that tasks' shares grow, and are sorted on disk.
MOST_PARTITIONS = 20_000
#: Target ids that are sent to every task at most; a longer list is joined by key.
TARGET_ROWS = 4_000_000

#: Keys of words are odd, keys of pairs even; the second bit is free. The beginning of a text is a word that no text has.
START, ALONE, FREE = np.uint64(1), np.uint64(1), np.uint64(2)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
BACKGROUND, TARGET, NEW = 0, 1, 2


@dataclass
class Models:
    counts: DataFrame  # key, t, b: occurrences in target and background documents; of the corpus itself also block
    target: int  # words in target documents
    background: int
    vocabulary: int

    def weights(self) -> tuple[float, float]:
        """What a count of either model is multiplied with, so that both have the fewer words of the two."""
        fewer = min(self.target, self.background)
        return (fewer / self.target, fewer / self.background) if fewer else (1.0, 1.0)


@dataclass
class Keys:
    """The words of some texts: per token its pair with the word before, the word before, and itself, as 64-bit keys."""

    pair: np.ndarray
    before: np.ndarray
    word: np.ndarray
    text: np.ndarray
    counts: np.ndarray  # tokens of each text


def keys_of(texts: pa.Array) -> Keys:
    w = words_of(texts)
    word = w.hashes() & ~FREE | ALONE
    before = np.full(len(word), START, np.uint64)
    before[1:] = word[:-1]
    counts = w.counts()
    before[w.first[:-1][counts > 0]] = START
    return Keys(mixed(before * _SPREAD + word) & ~(FREE | ALONE), before, word, w.text_of(), counts)


def with_target(docs: DataFrame, targets: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """docs with `side`: TARGET where the doc_id is in targets. A list of proven size goes to the tasks, a longer one is joined by key."""
    ids = targets.select(F.col("doc_id").alias("_t")).where("_t is not null").distinct()
    small = ids.limit(most + 1).count() <= most
    joined = docs.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("_t"), "left")
    return joined.withColumn("side", F.when(F.col("_t").isNotNull(), TARGET).otherwise(BACKGROUND)).drop("_t")


def in_blocks(docs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, side, block) of each row of docs, written in blocks of about BLOCK_BYTES; without targets, no model counts them."""
    docs = docs.select("doc_id", "text")
    docs = with_target(docs, targets) if targets is not None else docs.withColumn("side", F.lit(NEW))
    schema = T.StructType([*docs.schema.fields, T.StructField("block", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text"):
                if size + part.nbytes > BLOCK_BYTES and size:
                    block, size = block + 1, 0
                size += part.nbytes
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, block))], names=schema.names)

    return saved(in_tasks(docs, run, schema), "blocks")


def _partitions(blocks: DataFrame) -> int:
    """As many as there are blocks, so that a task's share does not grow with the corpus until there are very many."""
    return max(1, min(MOST_PARTITIONS, blocks.select("block").distinct().count()))


def lists(blocks: DataFrame) -> DataFrame:
    """(block, key, n): each block's distinct words, beginnings and pairs, with their occurrences in target (upper 32 bits) and background texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting = None, []

        def out() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(waiting))
            n = np.where(keys & FREE, np.int64(1 << 32), np.int64(1))
            keys &= ~FREE
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
            keys, n = keys[first], np.add.reduceat(n, first) if len(first) else n
            # Rows that differ in their key alone are moved in the fewest bytes.
            order = np.concatenate([np.flatnonzero(n == 1), np.flatnonzero(n == 1 << 32), np.flatnonzero((n != 1) & (n != 1 << 32))])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), pa.array(keys.view(np.int64)[order]), pa.array(n[order])], names=["block", "key", "n"])

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                own = part.column("block").to_numpy()
                for one in np.unique(own):
                    rows = part.filter(pa.array(own == one)) if own[0] != own[-1] else part
                    if one != block and waiting:
                        yield out()
                        waiting = []
                    block = int(one)
                    k = keys_of(rows.column("text"))
                    side = np.where(rows.column("side").to_numpy() == TARGET, FREE, np.uint64(0))[k.text]
                    first = k.before == START
                    waiting += [k.pair | side, k.word | side, k.before[first] | side[first]]
        if waiting:
            yield out()

    return in_tasks(blocks.select("text", "side", "block"), run, "block long, key long, n long")


def _sums() -> tuple[Column, Column]:
    """Occurrences in target and background texts over the rows of lists."""
    return F.sum(F.shiftright("n", 32)), F.sum(F.col("n").bitwiseAND(F.lit((1 << 32) - 1)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first, axis=0) if len(first) else counts


def _models(counts: DataFrame, words: Column) -> Models:
    total = counts.where(words & (F.col("key").bitwiseAND(F.lit(1)) == 1) & (F.col("key") != int(START)))
    total = total.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count("*").alias("v")).first()
    return Models(counts, total.t, total.b, total.v)


def fit(blocks: DataFrame) -> Models:
    """Models for other documents, as one table of all counts; blocks: from in_blocks, with targets."""
    return _models(saved(lists(blocks).groupBy("key").agg(*[c.alias(x) for c, x in zip(_sums(), "tb")]), "counts"), F.lit(True))


def fit_own(blocks: DataFrame) -> Models:
    """Models for the documents they count. The table has each block's words, and its pairs that other blocks have too."""
    key = Window.partitionBy("key").orderBy("block")
    all_ = key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t, b = (c.over(all_) for c in _sums())
    own = F.shiftright("n", 32) + F.col("n").bitwiseAND(F.lit((1 << 32) - 1))
    met = lists(blocks).repartition(_partitions(blocks), "key").select("block", "key", t.alias("t"), b.alias("b"), own.alias("own"), (F.row_number().over(key) == 1).alias("first"))
    met = met.where((F.col("t") + F.col("b") > F.col("own")) | (F.col("key").bitwiseAND(F.lit(1)) == 1)).drop("own")
    return _models(saved(met, "counts"), F.col("first"))


def _repeats(values: np.ndarray) -> np.ndarray:
    """Of each value, how often it occurs."""
    order = np.argsort(values)
    ranked = values[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, int)
    n = np.diff(np.append(first, len(ranked)))
    out = np.empty(len(values), np.int64)
    out[order] = np.repeat(n, n)
    return out


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, the place of each key among them)."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(keys)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def score(blocks: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_tokens, ce_target, ce_background, score) of each row of blocks, which is from in_blocks."""
    found = models.counts if "block" in models.counts.columns else lists(blocks).select("block", "key").join(models.counts, "key")
    found = found.select("block", "key", "t", "b")
    id_type = blocks.schema["doc_id"].dataType
    weights, words, size = models.weights(), (models.target, models.background), models.vocabulary + 1

    def one(docs: pa.Table, known: pa.Table) -> pa.Table:
        k = keys_of(docs.column("text").combine_chunks())
        side, n, begins = docs.column("side").to_numpy(), k.counts, k.before == START
        own, place = _places(np.concatenate([k.pair, k.word, [START]]))
        pair, word = place[: len(k.pair)], place[len(k.pair) : -1]
        before = np.where(begins, place[-1], np.concatenate((place[-1:], word))[:-1])
        keys = known.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        at = np.searchsorted(own, keys[order])
        counts = []
        for kind, c in ((TARGET, "t"), (BACKGROUND, "b")):
            mine = side[k.text] == kind
            count = np.bincount(np.concatenate([pair[mine], word[mine]]), minlength=len(own))
            count[place[-1]] = (begins & mine).sum()
            count[at] = known.column(c).to_numpy()[order]
            counts.append(count)
        base = k.text * len(own)
        own_word = _repeats(base + word)
        own_counts = _repeats(base + pair), np.where(begins, 1, np.concatenate(([1], own_word))[:-1]), own_word
        losses = np.empty((2, docs.num_rows))
        for m, kind in enumerate((TARGET, BACKGROUND)):
            seen = side[k.text] == kind
            c_pair, c_before, c_word = (weights[m] * (counts[m][x] - np.where(seen, o, 0)) for x, o in zip((pair, before, word), own_counts))
            p = (c_word + FLOOR) / (weights[m] * words[m] + FLOOR * size)
            p = (c_pair + WEIGHT * p) / (c_before + WEIGHT)
            losses[m] = np.bincount(k.text, -np.log2(p), docs.num_rows)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = losses / n
        cut = n == 0
        values = [pa.array(x, pa.float64(), mask=cut) for x in (*mean, mean[0] - mean[1])]
        return pa.table([docs.column("doc_id"), pa.array(n), *values], names=names)

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("ce_target", "ce_background", "score")]])
    names = schema.names
    turn, n = F.pmod(F.xxhash64("block"), F.lit(TURNS)), -(-_partitions(blocks) // TURNS)
    dealt = lambda df, k: df.where(turn == k).repartition(n, "block").groupBy("block")
    scored = [saved(dealt(blocks, k).cogroup(dealt(found, k)).applyInArrow(one, schema), "scored") for k in range(TURNS)]
    return reduce(DataFrame.unionByName, scored)


def compare(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The scores of docs (doc_id, text) by models of docs themselves, each document by what the others have; targets: doc_id."""
    blocks = in_blocks(docs, targets)
    return score(blocks, fit_own(blocks))
