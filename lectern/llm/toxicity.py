"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Every text becomes a short vector: densities of an insult lexicon and of a lexicon learned
from the labels, second-person words near lexicon words, capitals, punctuation, and
obfuscation. Spark ML fits trees and calibration on a bounded sample of labelled rows and
applies them in the JVM; scoring has no shuffle. A quarter of the sample is set aside for the calibration:
neither lexicon nor trees are learned from it. With fewer than LEAST_KIND labels of one kind nothing is
set aside, and all three are learned from all of the sample.

Edge cases: null and empty texts have the zero vector and are scored like any other; a null
label, or a label of an unknown document, is not learned from; repeated labels of a document
count once, the highest; with no label of one of the two kinds the score is the other kind's
(no labels at all: 0). Repeated rows get equal scores. Other columns pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.batches import fresh_name, in_tasks, saved, slices, with_columns
from lectern.llm.words import Words, buffers, words_of

#: Labelled documents that are learned from at most: those with the lowest hash of their id.
MAX_LABELLED = 20_000
#: Labels of each kind from which on some are set aside for calibration.
LEAST_KIND = 40
#: Entries of the learned lexicon, and what a stem must show to enter it.
LEXICON_SIZE, LEAST_DOCUMENTS, LEAST_Z = 512, 8, 6.0
#: A stem is a word, or its first so many bytes.
STEM_BYTES = (4, 5, 6, 7, 8)
NEAR_WORDS = 5
WINDOW_WORDS = 64

#: Some common insults, one feature among others, and second-person words.
INSULTS = "idiot idiots moron morons stupid dumb fool loser losers trash scum clown pathetic worthless disgusting ugly jerk creep freak imbecile dimwit filth vermin lowlife garbage coward liar".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split()
#: Signs that stand for letters in disguised words.
DISGUISE = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

FEATURES = (
    "insult_density", "learned_density", "learned_weight", "learned_peak", "hit_words", "second_person", "near_second_person",
    "capitals", "capital_words", "exclamations", "punctuation", "disguised", "disguised_insults", "log_words", "word_length",
)

_UPPER, _SIGN, _MARK, _ALPHA = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MARK[[ord(c) for c in "@$*013457!+"]] = True
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UNDISGUISE = np.arange(256, dtype=np.uint8)
for _sign, _letter in DISGUISE.items():
    _UNDISGUISE[ord(_sign)] = ord(_letter)


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(words_of(pa.array(words)).hashes())


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted known ones, or -1. A bitmap of the low bits settles most at once."""
    found = np.full(len(values), -1)
    if len(known):
        bits = np.zeros(1 << 16, bool)
        bits[known & np.uint64(0xFFFF)] = True
        maybe = np.flatnonzero(bits[values & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
        hit = known[at] == values[maybe]
        found[maybe[hit]] = at[hit]
    return found


def stems(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) for whole words and for each prefix length; longer than the prefix only."""
    out = [(np.arange(len(w.start)), w.hashes())]
    for n in STEM_BYTES:
        long = np.flatnonzero(w.end - w.start > n)
        out.append((long, w.hashes(w.start[long], w.start[long] + n) ^ np.uint64(n)))
    return out


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
    return sums[first[1:]] - sums[first[:-1]]


def features(texts: pa.Array, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row per text, one column per entry of FEATURES."""
    w, (raw, at) = words_of(texts), buffers(texts)
    n = w.counts().astype(float)
    per_word = lambda x: _per_text(x, w.first) / np.maximum(n, 1)
    chars = np.maximum(np.diff(at), 1)
    per_char = lambda x: _per_text(x, at) / chars
    whole = w.hashes()
    insult = _in(whole, _hashes(INSULTS)) >= 0
    weight = np.zeros(len(whole))
    for where, hashes in stems(w):
        place = _in(hashes, lexicon)
        hit = place >= 0
        np.maximum.at(weight, where[hit], weights[place[hit]])
    learned = weight > 0
    you = _in(whole, _hashes(SECOND_PERSON)) >= 0
    sums = np.concatenate(([0], np.cumsum(you)))
    text = w.text_of()
    lo = np.maximum(np.arange(len(you)) - NEAR_WORDS, w.first[text]) if len(you) else text
    hi = np.minimum(np.arange(len(you)) + NEAR_WORDS + 1, w.first[text + 1]) if len(you) else text
    near = (insult | learned) & (sums[hi] > sums[lo])
    hits = np.concatenate(([0], np.cumsum(insult | learned)))
    ahead = np.minimum(np.arange(len(you)) + WINDOW_WORDS, w.first[text + 1]) if len(you) else text
    peak = np.zeros(len(n))
    np.maximum.at(peak, text, (hits[ahead] - hits[:-1]) / WINDOW_WORDS)

    upper, alpha = _UPPER[raw], _ALPHA[raw]
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = _MARK[raw[1:-1]] & alpha[:-2] & alpha[2:]
    open_letters = _UNDISGUISE[raw] if inner.any() else raw
    plain = np.zeros(len(n))
    if inner.any():
        text_again = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(open_letters.tobytes()))
        shown = words_of(text_again)
        plain = np.maximum(_per_text(_in(shown.hashes(), _hashes(INSULTS)) >= 0, shown.first) - _per_text(insult, w.first), 0)
    shout = np.zeros(len(n))
    if len(raw):
        caps = np.concatenate(([0], np.cumsum(upper)))
        runs = np.flatnonzero(np.diff(np.concatenate(([0], upper.view(np.int8), [0]))) == 1)
        ends = np.flatnonzero(np.diff(np.concatenate(([0], upper.view(np.int8), [0]))) == -1)
        long = ends - runs >= 3
        np.add.at(shout, np.searchsorted(at, runs[long], side="right") - 1, (caps[ends[long]] - caps[runs[long]]).astype(float))
    columns = [
        per_word(insult), per_word(learned), per_word(weight), peak, np.log1p(_per_text(insult | learned, w.first)), per_word(you), per_word(near),
        per_char(upper), shout / chars, per_char(raw == 33), per_char(_SIGN[raw]), per_char(inner), plain / np.maximum(n, 1),
        np.log1p(n), per_word(w.end - w.start),
    ]
    return np.column_stack(columns)


@dataclass
class Toxicity:
    lexicon: np.ndarray
    weights: np.ndarray
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0


def with_features(df: DataFrame, name: str, lexicon: np.ndarray, weights: np.ndarray, text: str = "text") -> DataFrame:
    def make():
        def compute(texts: pa.Array) -> list:
            rows = features(texts, lexicon, weights)
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))]

        return compute

    return with_columns(df, text, [T.StructField(name, T.ArrayType(T.DoubleType()))], make)


def learn_lexicon(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted stem hashes, weights) of the stems that toxic documents use far more often; labelled: text, toxic."""

    def count(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", 2 << 20)):
            w = words_of(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            text = w.text_of()
            keys = np.concatenate([h for _, h in stems(w)])
            texts = np.concatenate([text[where] for where, _ in stems(w)])
            order = np.lexsort((texts, keys))
            keys, texts = keys[order], texts[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
            keys, bad = keys[new], toxic[texts[new]] == 1
            unique, inverse = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unique.view(np.int64)), pa.array(np.bincount(inverse, bad, len(unique)).astype(np.int64)), pa.array(np.bincount(inverse, ~bad, len(unique)).astype(np.int64))],
                names=["stem", "bad", "good"],
            )

    total = labelled.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("b"), F.count(F.when(F.col("toxic") == 0, 1)).alias("g")).first()
    if not total.b or not total.g:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = in_tasks(labelled.select("text", "toxic"), count, "stem long, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    p = (F.col("bad") + F.col("good")) / (total.b + total.g)
    gap = F.col("bad") / total.b - F.col("good") / total.g
    z = gap / F.sqrt(p * (1 - p) * (1 / total.b + 1 / total.g) + 1e-12)
    weight = F.log((F.col("bad") + 0.5) / total.b / ((F.col("good") + 0.5) / total.g))
    best = counts.where(F.col("bad") >= LEAST_DOCUMENTS).select("stem", z.alias("z"), weight.alias("weight")).where(f"z >= {LEAST_Z} and weight > 0")
    rows = best.orderBy(F.desc("z"), "stem").limit(LEXICON_SIZE).collect()
    stem = np.array([r.stem for r in rows], np.int64).view(np.uint64)
    order = np.argsort(stem)
    return stem[order], np.array([r.weight for r in rows], float)[order]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Toxicity:
    """docs: doc_id, text; labels: doc_id, toxic. Leave held-out documents out of labels."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("pick", F.xxhash64("doc_id")).orderBy("pick", "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_labelled small rows
    rows = saved(rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("pick").alias("pick"), F.min("text").alias("text")), "labelled")
    kinds = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), None, None, float(max(kinds, default=0)))
    calibrating = fitting = F.lit(True)
    if min(kinds.values()) >= LEAST_KIND:
        calibrating = F.pmod(F.shiftright("pick", 8), F.lit(4)) == 0
        fitting = ~calibrating
    lexicon, weights = learn_lexicon(rows.where(fitting))
    table = with_features(rows, "features", lexicon, weights).select("toxic", "pick", array_to_vector("features").alias("features"))
    table = saved(table.repartition(8, "pick"), "features")
    trees = GBTClassifier(labelCol="toxic", maxIter=20, maxDepth=3, stepSize=0.2, seed=7).fit(table.where(fitting))
    margin = vector_to_array("rawPrediction")[1]
    scored = trees.transform(table.where(calibrating)).select(F.col("toxic").cast("double").alias("label"), margin.alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(scored)
    return Toxicity(lexicon, weights, trees, calibration)


def score(docs: DataFrame, model: Toxicity, name: str = "score") -> DataFrame:
    """docs with a column `name`: the calibrated probability that a text is toxic."""
    if model.trees is None:
        return docs.withColumn(name, F.lit(model.constant))
    kept = docs.columns
    array, vector, raw, prob, pred, margin, cal = (fresh_name(docs, x) for x in ("tox_array", "tox_vector", "tox_raw", "tox_prob", "tox_pred", "tox_margin", "tox_calibrated"))
    out = with_features(docs, array, model.lexicon, model.weights).withColumn(vector, array_to_vector(array))
    trees = model.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred)
    out = trees.transform(out).withColumn(margin, vector_to_array(raw)[1])
    out = model.calibration.copy().setFeaturesCol(margin).setPredictionCol(cal).transform(out)
    return out.select(*kept, F.least(F.greatest(F.col(cal), F.lit(0.0)), F.lit(1.0)).alias(name))
