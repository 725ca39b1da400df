"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact shingle similarity.

An item matches a window of as many words if the weighted Jaccard similarity of their five-word
shingles, each weighted by the length of its words, is THRESHOLD or more.

Every window of a text gets 64-bit SimHashes of its words, one for each window length; running votes serve all lengths. A
window's length is the item's, rounded down to a geometric series of ratio STEP so that a few lengths serve all items. As edits
at an item's ends may leave a match, windows without the words that these may take are fingerprinted as well.
Fingerprints are cut into RADIUS + 1 blocks: two of them within RADIUS bits agree in one
block at least, so looking up each block finds all within the radius. What is found is compared with the item exactly, in all windows
of the item's own number of words around it, and only matches count.

So all fingerprints within the radius are found, and all that is reported is a match. That a match's fingerprint lies within the radius is very
likely, not sure (the README has the measured recall). With `exact`, the shingles of each item that are rarest in the benchmark are looked up
as well, as many as weigh more than 1 - THRESHOLD of it: no window without one of them can match, so nothing is missed whatever the edits.

A benchmark's distinct items go to the tasks in chunks of bounded bytes, each in a pass of its own: what one pass has
found is written to the shared folder before the next, so driver and tasks hold one chunk at a time.
Texts are never shuffled.

Edge cases: null and empty texts have no leak; null, empty and wordless items match nothing; an item
of fewer than five words has one shingle and counts only if found whole; items with equal texts are reported each by their
item_id, once per document and item_id; repeated items count as one. Other columns of
the documents pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.batches import fresh_name, in_tasks, saved, slices
from lectern.llm.words import Words, shingle_hashes, words_of
from lectern.operators.numbering import running_sum

SHINGLE_WORDS, THRESHOLD = 5, 0.8
RADIUS = 5
#: The ratio of neighbouring window lengths.
STEP = 1.25
#: Benchmark text that a task holds at once, about (an item is in one chunk whatever its size).
CHUNK_BYTES = 16 << 20
#: Text of which all windows are made at once.
SLICE = 1 << 18

LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("word", T.LongType()), T.StructField("similarity", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("word", pa.int64()), ("similarity", pa.float64())]))


def window_length(words: int) -> int:
    """The largest of the rounded powers of STEP that is not above `words`."""
    length, power = 1, 1.0
    while int(power) <= words:
        length, power = int(power), power * STEP
    return length


def spare(words: int) -> int:
    """Words at the ends of an item that a window may lack and still reach THRESHOLD, if words are of one length."""
    return int(max(0, words - SHINGLE_WORDS + 1) * (1 - THRESHOLD) / (1 + THRESHOLD) + 1e-9)


def runs_of(words: int) -> list[tuple[int, int]]:
    """(length, offset) of the windows of an item that are fingerprinted: of its own size from either end, and, as edits at an end may
    take `spare` words from it, windows without these at its beginning, middle and end."""
    whole, inner = window_length(words), window_length(words - spare(words))
    return sorted({(whole, 0), (whole, words - whole), *((inner, at) for at in (0, (words - inner) // 2, words - inner))})


def running_votes(hashes: np.ndarray, longest: int) -> np.ndarray:
    """Counts of set bits, bit by bit, before each word; they may wrap, as differences over `longest` words still fit."""
    kind = np.min_scalar_type(longest)
    votes = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64), axis=0, out=votes[1:], dtype=kind)
    return votes


def fingerprints(votes: np.ndarray, length: int) -> np.ndarray:
    """SimHash of every `length` consecutive words: a bit is set if more than half of the words have it."""
    return np.packbits(votes[length:] - votes[:-length] > votes.dtype.type(length // 2), axis=1).view(np.uint64).ravel()


def blocks(length: int = 64, parts: int = RADIUS + 1) -> list[tuple[int, int]]:
    """(shift, bits) of `parts` blocks that make up the fingerprint."""
    ends = [round(length * k / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


class Index:
    """The items of one window length, by the value of each block of their fingerprints."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for shift, bits in blocks():
            value = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            ends = np.cumsum(np.bincount(value, minlength=1 << bits))
            ends = np.concatenate(([0], ends))
            self.tables.append((np.uint64(shift), np.uint64((1 << bits) - 1), order, ends, np.diff(ends) > 0))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) whose fingerprints differ in at most RADIUS bits."""
        found = []
        for shift, mask, order, ends, known in self.tables:
            value = ((prints >> shift) & mask).astype(np.int64)
            window = np.flatnonzero(known[value])
            value = value[window]
            count = ends[value + 1] - ends[value]
            item = order[np.repeat(ends[value] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            window = np.repeat(window, count)
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            found.append(window[near] * len(self.prints) + item[near])
        both = np.unique(np.concatenate(found))
        return both // len(self.prints), both % len(self.prints)


class Rare:
    """Of each item its rarest shingles that weigh more than 1 - THRESHOLD of it, by their hashes."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, weights: np.ndarray):
        _, place, known = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.lexsort((known[place], items))
        items, weights = items[order], weights[order]
        sums = np.cumsum(weights) - weights
        first = np.searchsorted(items, items)
        whole = np.bincount(items, weights) if len(items) else np.zeros(0)
        taken = (sums - sums[first]) <= whole[items] * (1 - THRESHOLD + 1e-9)
        keys, items = keys[order][taken], items[taken]
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        bits = max(16, (len(keys) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.keys >> self.shift] = True

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in shingles, item)."""
        place = np.flatnonzero(self.maybe[shingles >> self.shift])
        low, high = (np.searchsorted(self.keys, shingles[place], side) for side in ("left", "right"))
        count = high - low
        item = self.items[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        return np.repeat(place, count), item


class Benchmark:
    def __init__(self, item_ids: list[int], texts: list[str], exact: bool = True):
        w = words_of(pa.array(texts, pa.string()))
        hashes, lengths = w.hashes(), w.end - w.start
        self.item_ids, self.words = np.array(item_ids, np.int64), w.counts()
        by_length: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(self.words).tolist():
            for length, at in runs_of(int(self.words[k])):
                by_length.setdefault(length, []).append((k, at))
        self.longest = max(by_length, default=1)
        votes = running_votes(hashes, self.longest)
        self.spare = np.array([spare(n) for n in self.words.tolist()], np.int64)
        self.lengths = []
        for length, own in sorted(by_length.items()):
            own, offset = np.array(own).T
            place = w.first[own] + offset
            self.lengths.append((length, own, offset, Index(fingerprints(votes, length)[place])))

        # Each item's distinct shingles, sorted, with their counts and weights.
        keys, at = shingle_hashes(hashes, w.first, SHINGLE_WORDS)
        item = np.repeat(np.arange(len(item_ids)), np.diff(at))
        start = np.arange(len(keys)) - at[item] + w.first[item]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        weight = sums[start + np.minimum(self.words[item], SHINGLE_WORDS)] - sums[start]
        order = np.lexsort((keys, item))
        keys, item, weight = keys[order], item[order], weight[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])))) if len(keys) else np.zeros(0, int)
        self.counts = np.diff(np.append(first, len(keys)))
        self.keys, self.weights = keys[first], weight[first]
        self.first = np.searchsorted(item[first], np.arange(len(item_ids) + 1))
        self.weight = np.bincount(item, weight, len(item_ids)).astype(np.int64)
        self.exact = exact
        self.rare = Rare(self.keys, item[first], self.weights * self.counts)
        self.sizes = sorted({min(n, SHINGLE_WORDS) for n in self.words.tolist() if n})

    def _proposed(self, w: Words, hashes: np.ndarray, shingles: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, low, high): words from low to high at which a window may match."""
        text = w.text_of()
        votes = running_votes(hashes, self.longest)
        low, high, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length, own, offset, index in self.lengths:
            if len(hashes) >= length:
                windows, found = index.within(fingerprints(votes, length))
                inside = text[windows] == text[windows + length - 1]
                windows, found = windows[inside], found[inside]
                item, first = own[found], w.first[text[windows]]
                start = windows - offset[found]
                low.append(np.maximum(start - self.spare[item], first))
                high.append(np.minimum(np.maximum(start + self.spare[item], first), windows))
                items.append(item)
        for size, (own, start) in shingles.items() if self.exact else ():
            place, found = self.rare.find(own)
            fits = np.minimum(self.words[found], SHINGLE_WORDS) == size
            place, found = place[fits], found[fits]
            low.append(np.maximum(start[place] - (self.words[found] - size), w.first[text[start[place]]]))
            high.append(start[place])
            items.append(found)
        low, high, items = np.concatenate(low), np.concatenate(high), np.concatenate(items)
        text = text[low]
        order = np.lexsort((low, items, text))
        return text[order], items[order], low[order], high[order]

    def leaks(self, texts: pa.Array) -> list[list[dict]]:
        w: Words = words_of(texts)
        hashes, lengths = w.hashes(), w.end - w.start
        out: list[dict[int, dict]] = [{} for _ in range(len(texts))]
        if not len(hashes) or not len(self.keys):
            return [[] for _ in out]
        shingles = {}
        for size in self.sizes:
            count = np.maximum(w.counts() - size + 1, 0)
            start = np.arange(count.sum()) + np.repeat(w.first[:-1] - (np.cumsum(count) - count), count)
            if size == SHINGLE_WORDS:
                own, at = shingle_hashes(hashes, w.first, size)
                own = own[np.repeat(w.counts() >= size, np.diff(at))]
            else:  # each run of words as a text of its own, as shorter items are hashed
                runs = hashes[start[:, None] + np.arange(size)].ravel()
                own = shingle_hashes(runs, np.arange(len(start) + 1) * size, SHINGLE_WORDS)[0]
            shingles[size] = own, start
        sums = np.concatenate(([0], np.cumsum(lengths)))
        # Weights of all shingles that begin before each word; differences count within a text only.
        before = {size: np.concatenate(([0], np.cumsum(sums[size:] - sums[:-size]))) for size in self.sizes if len(hashes) >= size}
        text, item, low, high = self._proposed(w, hashes, shingles)
        joins = np.zeros(len(text), bool)
        if len(text):
            # A group's highest word so far: groups are apart by more than any word's number.
            group = np.cumsum(np.concatenate(([False], (text[1:] != text[:-1]) | (item[1:] != item[:-1])))) * (len(hashes) + 2)
            joins[1:] = low[1:] + group[1:] <= np.maximum.accumulate(high + group)[:-1] + 1
            joins[1:] &= group[1:] == group[:-1]
        runs = np.flatnonzero(~joins)
        for t, k, a, b in zip(text[runs].tolist(), item[runs].tolist(), low[runs].tolist(), (np.maximum.reduceat(high, runs) if len(runs) else high).tolist()):
            size, stop = min(int(self.words[k]), SHINGLE_WORDS), int(w.first[t + 1])
            b = min(b, stop - size)
            if b < a:
                continue
            own, start = shingles[size]
            at = int(np.searchsorted(start, a))
            like = self._similarities(k, own[at : at + b - a + int(self.words[k]) - size + 1][: stop - size - a + 1], before[size], a, b, stop)
            best = int(np.argmax(like))
            item_id, value = int(self.item_ids[k]), float(like[best])
            if value >= THRESHOLD and (item_id not in out[t] or value > out[t][item_id]["similarity"]):
                out[t][item_id] = {"item_id": item_id, "word": a + best - int(w.first[t]), "similarity": value}
        return [[x[k] for k in sorted(x)] for x in out]

    def _similarities(self, k: int, shingles: np.ndarray, before: np.ndarray, a: int, b: int, stop: int) -> np.ndarray:
        """Of item k with each window that begins at words a to b; shingles: from word a on; stop: the text's end.

        The q-th shingle adds to the windows that hold it, but not as many of the same before it as the item has.
        """
        words, own = int(self.words[k]), slice(self.first[k], self.first[k + 1])
        size = min(words, SHINGLE_WORDS)
        keys, counts, weights = self.keys[own], self.counts[own], self.weights[own]
        which = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        q = np.flatnonzero(keys[which] == shingles)
        order = np.argsort(which[q], kind="stable")
        q = q[order]
        which = which[q]
        earlier = np.arange(len(q)) - counts[which]
        same = earlier >= np.searchsorted(which, which)
        low = np.maximum(np.where(same, q[np.maximum(earlier, 0)] + 1, 0), q - (words - size))
        n = b - a + 1
        low, high = np.minimum(np.maximum(low, 0), n), np.minimum(q + 1, n)
        high = np.maximum(low, high)
        steps = np.bincount(low, weights[which], n + 1) - np.bincount(high, weights[which], n + 1)
        both = np.cumsum(steps)[:n]
        start = np.arange(a, b + 1)
        either = self.weight[k] + before[np.minimum(start + words, stop) - size + 1] - before[start] - both
        return both / either


def in_chunks(known: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items with `chunk`, each chunk of about CHUNK_BYTES (or of one longer item), and how many chunks there are."""
    known = known.distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= CHUNK_BYTES:
        return known.withColumn("chunk", F.lit(0)), 1
    numbered = running_sum(known.withColumn("_all", F.lit(0)), "_all", [F.xxhash64("item_id", "text"), F.col("item_id"), F.col("text")], F.octet_length("text").cast("bigint"), "_upto", most=10_000)
    chunks = saved(numbered.select("item_id", "text", F.floor(F.col("_upto") / CHUNK_BYTES).cast("int").alias("chunk")), "benchmark")
    return chunks, total // CHUNK_BYTES + 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks", text: str = "text", exact: bool = True) -> DataFrame:
    """docs with a column `name`: the items that a text holds, with the best place (a word's number) and similarity of each.

    `exact`: rare shingles propose places beside the fingerprints, so that no match is missed; without it, fingerprints alone decide where to look.
    """
    known, chunks = in_chunks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null"))
    columns = []
    out = docs
    for k in range(chunks):
        rows = known.where(F.col("chunk") == k).collect()  # one chunk of bounded size
        columns.append(fresh_name(out, f"leaks_{k}"))
        out = _against(out, [r.item_id for r in rows], [r.text for r in rows], columns[-1], text, exact)
        if k < chunks - 1:  # else the passes would share a task, each with its own index
            out = saved(out, "leaks")
    found = F.concat(*columns) if chunks > 1 else F.col(columns[0])
    return out.select(*docs.columns, found.alias(name))


def _against(docs: DataFrame, item_ids: list[int], texts: list[str], name: str, text: str, exact: bool) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, LEAK)])

    def run(batches):
        items = Benchmark(item_ids, texts, exact)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(items.leaks(part.column(text)), _ARROW)], names=schema.names)

    return in_tasks(docs, run, schema)
