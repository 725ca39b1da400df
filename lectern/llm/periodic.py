"""Periodic runs of words by the Gusfield-Stoye method.

A run is a longest stretch of words of smallest period q with at least LEAST words and TIMES * q of them. The method:

1. Lempel-Ziv blocks of the text: each is the longest stretch that also begins earlier. The first place of any square
   (a stretch followed by itself) crosses a block's border, so extensions to both sides of the borders give
   a set of squares from which every square of the text comes by rotation, at its first place.
2. The suffix tree, as intervals of the suffix array: a square is a point in it. Suffix links with one more letter lead
   from each square to its rotation; where the rotation is a stretch of the text its point is marked, until all squares are.
3. The leaves below the marked points are all places of all squares. Places of one period that follow
   each other merge into runs. Only squares whose root is no power are kept, so q is the smallest period.

All texts of a slice are one text with a separator of its own kind after each stretch; suffix array, extensions and
intervals come from names of stretches of 1, 2, 4, .. words, as arrays. Before, words that can't be in a run are left out:
every three words in a row within a run come at least three times in it (a run of period 1 has LEAST >= 6 words, else there are
4q - 2 >= 3q places of three words), so stretches whose three-word windows don't are taken out, again and again until none is.

Edge cases: null and empty texts have no word and no run; a text's words are its runs of characters other than
blank, tab and line breaks of ASCII; repeated rows get equal results; an empty table gives none; other columns pass through; a new
column whose name is taken gets underscores in front. A task needs some 300 bytes for each word in stretches that repeat so, besides its text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.batches import fresh_fields, in_tasks, slices

LEAST, TIMES = 6, 4


class SuffixTree:
    """Suffix array of non-negative integers, its names of stretches of 2**k letters, and intervals as the tree's points."""

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        _, name = np.unique(text, return_inverse=True)
        self.names, step = [name.astype(np.int32)], 1
        while name.max(initial=0) + 1 < n:
            key = self.names[-1].astype(np.int64) * (n + 1)
            key[: n - step] += self.names[-1][step:] + 1
            _, name = np.unique(key, return_inverse=True)
            self.names.append(name.astype(np.int32))
            step *= 2
        self.rank = self.names[-1].astype(np.int64)
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        self.text = self.names[0].astype(np.int64)
        shared = np.zeros(n, np.int64)
        shared[1:] = self.ahead(self.order[:-1], self.order[1:])
        self.lows = [shared.astype(np.int32)]  # of 2**k neighbours from each place on, the least that one shares with the one before it
        while 2 ** len(self.lows) <= n:
            half, before = 2 ** (len(self.lows) - 1), self.lows[-1]
            self.lows.append(np.minimum(before[:-half], before[half:]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters from i and from j on are the same."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            fits = np.maximum(i, j) + (1 << k) <= self.n
            same = np.flatnonzero(fits)[self.names[k][i[fits]] == self.names[k][j[fits]]]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - start

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters up to i and up to j, both included, are the same; none before the text."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            fits = np.minimum(i, j) + 1 >= 1 << k
            same = np.flatnonzero(fits)[self.names[k][i[fits] - (1 << k) + 1] == self.names[k][j[fits] - (1 << k) + 1]]
            i[same] -= 1 << k
            j[same] -= 1 << k
        return start - i

    def low(self, rank: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first leaf of the interval of suffixes that share `depth` letters with the one of that rank."""
        at = rank.copy()
        for k in range(len(self.lows) - 1, -1, -1):
            fits = at - (1 << k) + 1 >= 0
            go = np.flatnonzero(fits)[self.lows[k][at[fits] - (1 << k) + 1] >= depth[fits]]
            at[go] -= 1 << k
        return at

    def high(self, rank: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last leaf of that interval."""
        at = rank.copy()
        for k in range(len(self.lows) - 1, -1, -1):
            fits = at + (1 << k) < self.n
            go = np.flatnonzero(fits)[self.lows[k][at[fits] + 1] >= depth[fits]]
            at[go] += 1 << k
        return at

    def below(self, rank: np.ndarray, depth: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """A leaf's rank below the point of `depth` letters, down the edge that goes on with `letter`; -1 if there is none."""
        lo, hi = self.low(rank, depth), self.high(rank, depth)
        last = hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._letter(mid, depth[open_]) < letter[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        found = (lo <= last) & (self._letter(lo, depth) == letter)
        return np.where(found, lo, -1)

    def _letter(self, rank: np.ndarray, depth: np.ndarray) -> np.ndarray:
        at = self.order[rank] + depth
        return np.where(at < self.n, self.text[np.minimum(at, self.n - 1)], -1)


def blocks(tree: SuffixTree) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin: each is the longest stretch that also begins earlier, or one new letter."""
    order = tree.order.tolist()
    near = [[-1] * tree.n, [-1] * tree.n]  # of each place, the closest leaf to either side that begins earlier
    for side, leaves in enumerate((order, order[::-1])):
        stack: list[int] = []
        for place in leaves:
            while stack and stack[-1] > place:
                stack.pop()
            if stack:
                near[side][place] = stack[-1]
            stack.append(place)
    longest = np.zeros(tree.n, np.int64)
    for found in map(np.array, near):
        has = np.flatnonzero(found >= 0)
        longest[has] = np.maximum(longest[has], tree.ahead(has, found[has]))
    begins, at, size = [], 0, longest.tolist()
    while at < tree.n:
        begins.append(at)
        at += max(1, size[at])
    return np.array(begins, np.int64)


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of sum(counts) items, whose it is and its number there, from 1."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def covering(tree: SuffixTree, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of squares that cover all leftmost ones: they cross a block's border."""
    ends = np.append(begins[1:], tree.n)
    size = ends - begins
    starts, halves = [], []
    # The second half holds the border behind the block, the first half begins at most its length before it.
    whose, half = _counted(np.where(ends < tree.n, size, 0))
    h, q = ends[whose], ends[whose] - half
    right, left = tree.ahead(h, q), tree.back(h - 1, np.maximum(q - 1, 0))
    left[q == 0] = 0
    good = (left + right >= half) & (right > 0)
    starts.append(np.maximum(q - left, q - half + 1)[good]), halves.append(half[good])
    # The first half holds the border before the block.
    both = size + np.append(size[1:], 0)
    whose, half = _counted(np.where(begins > 0, np.minimum(both, tree.n - 1 - begins), 0))
    h, q = begins[whose], begins[whose] + half
    right, left = tree.ahead(h, q), tree.back(h - 1, q - 1)
    start = np.maximum(h - left, h - half + 1)
    good = (left + right >= half) & (right > 0) & (left > 0) & (start + half <= ends[whose])
    starts.append(start[good]), halves.append(half[good])
    return np.concatenate(starts), np.concatenate(halves)


def least_factors(n: int) -> np.ndarray:
    """The least prime factor of each number up to n."""
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            own = out[p * p :: p]
            own[own == np.arange(p * p, n + 1, p)] = p
    return out


def primitive(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether each square's root is no power of a shorter stretch."""
    out, left = np.ones(len(start), bool), half.copy()
    factor = least_factors(int(half.max(initial=1)))
    while len(open_ := np.flatnonzero(out & (left > 1))):
        prime = factor[left[open_]]
        step = half[open_] // prime
        out[open_] = tree.ahead(start[open_], start[open_] + step) < 2 * half[open_] - step
        left[open_] //= prime
    return out


def vocabulary(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, half length) of the point of every square that comes from those given by rotation.

    A rotation is one suffix link, and one letter further down. Links that stay on the path of one leaf are taken together;
    where that leaf goes on otherwise, the edge with the right letter is looked for.
    """
    seen = np.zeros(0, np.int64)
    while len(start):
        steps = np.minimum(tree.ahead(start, start + half) - half, half - 1)  # rotations that begin at the next places
        whose, k = _counted(steps + 1)
        place, size = start[whose] + k - 1, half[whose]
        point = np.unique(tree.low(tree.rank[place], 2 * size) * (tree.n + 1) + size)
        new = point[~np.isin(point, seen, assume_unique=True)]
        seen = np.concatenate((seen, new))
        # Only where a new point was the last on its leaf's path does the walk go on.
        ends = steps < half - 1
        place, size = start[ends] + steps[ends], half[ends]
        known = np.isin(tree.low(tree.rank[place], 2 * size) * (tree.n + 1) + size, new)
        place, size = place[known], size[known]
        leaf = tree.below(tree.rank[place + 1], 2 * size - 1, tree.text[place])
        there = leaf >= 0
        start, half = tree.order[leaf[there]], size[there]
        pairs = np.unique(start * (tree.n + 1) + half)
        start, half = pairs // (tree.n + 1), pairs % (tree.n + 1)
    return seen // (tree.n + 1), seen % (tree.n + 1)


def runs_of(letters: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of one text, by start and period."""
    none = np.zeros((0, 3), np.int64)
    if len(letters) < least:
        return none
    tree = SuffixTree(letters)
    start, half = covering(tree, blocks(tree))
    sound = primitive(tree, start, half)
    first, half = vocabulary(tree, start[sound], half[sound])
    if not len(first):
        return none
    whose, k = _counted(tree.high(first, 2 * half) - first + 1)
    place, half = tree.order[first[whose] + k - 1], half[whose]
    order = np.lexsort((place, half))
    place, half = place[order], half[order]
    head = np.flatnonzero(np.concatenate(([True], (half[1:] != half[:-1]) | (place[1:] != place[:-1] + 1))))
    length = np.diff(np.append(head, len(place))) - 1 + 2 * half[head]
    found = np.stack((place[head], length, half[head]), axis=1)
    found = found[length >= np.maximum(least, times * half[head])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeating(letters: np.ndarray, whose: np.ndarray, window: int = 3, times: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of stretches, each of one text, in which every `window` letters in a row come `times` times; others hold no run.

    letters may be hashes: that letters agree by chance only leaves more in. Stretches shorter than LEAST are left out.
    """
    if len(letters) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(letters) - window + 1
    with np.errstate(over="ignore"):
        gram = np.zeros(n, np.int64)
        for k in range(window):
            gram = (gram ^ letters[k : k + n]) * np.int64(0x2545F4914F6CDD1D)
            gram ^= gram >> 29
    place = np.arange(n)
    stretch = whose[:n].copy()
    place = place[whose[:n] == whose[window - 1 :]]
    while True:
        with np.errstate(over="ignore"):
            key = gram[place] + stretch[place] * np.int64(0x1E3779B97F4A7C15)
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        stays = count[back] >= times
        done = stays.all()
        place = place[stays]
        head = np.concatenate(([True], (place[1:] != place[:-1] + 1) | (whose[place[1:]] != whose[place[:-1]]))) if len(place) else np.zeros(0, bool)
        number = np.cumsum(head) - 1
        long = np.bincount(number)[number] >= LEAST - window + 1 if len(place) else head
        done, place = done and long.all(), place[long]
        if done:
            begin = place[head]
            return begin, np.append(place[np.flatnonzero(head)[1:] - 1], place[-1:]) + window if len(place) else begin
        number = number[long]
        stretch[place] = number


def find_runs(words: list[list]) -> list[np.ndarray]:
    """Of each list of words, its runs (start, length, period) by start and period."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    offset = np.concatenate(([0], np.cumsum(sizes)))
    whose = np.repeat(np.arange(len(words)), sizes)
    begin, end = repeating(np.fromiter(map(hash, flat), np.int64, len(flat)), whose)
    number: dict = {}
    parts, places = [], []
    for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
        parts.append(np.fromiter((number.setdefault(x, len(number)) for x in flat[a:b]), np.int64, b - a))
        parts.append(np.array([-1 - k]))
        places.append(np.arange(a, b + 1))
    if not parts:
        return [np.zeros((0, 3), np.int64) for _ in words]
    letters = np.concatenate(parts)
    found = runs_of(letters - letters.min())
    found[:, 0] = np.concatenate(places)[found[:, 0]]
    at = np.searchsorted(offset, found[:, 0], side="right") - 1
    found[:, 0] -= offset[at]
    order = np.lexsort((found[:, 2], found[:, 0], at))
    found, at = found[order], at[order]
    cut = np.searchsorted(at, np.arange(len(words) + 1))
    return [found[a:b] for a, b in zip(cut, cut[1:])]


def folded(words: list[bytes], key: str) -> list[bytes]:
    """Words of a text whose tail repeats, by a rule of its key alone: with h = crc32(key) and g = h // 10, one key in ten (h % 10 = 0) has
    from word a = g % n on the words of a stretch of 1 + (n - a) // (3 + g % 8) words again and again. Others stay as they are."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: of each run, those of its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


_LONG, _STRING = T.LongType(), T.StringType()
#: Columns of `summarise`, and of `runs`.
SUMMARY = [("n_runs", _LONG), ("start", _LONG), ("length", _LONG), ("period", _LONG), ("exponent_milli", _LONG), ("runs_sha256", _STRING), ("collapsed_sha256", _STRING)]
RUNS = T.ArrayType(T.StructType([T.StructField(n, _LONG) for n in ("start", "length", "period")]))


def _in_tasks(docs: DataFrame, text: str, key: str | None, drop: bool, fields: list[T.StructField], make) -> DataFrame:
    """docs with the columns that make(words of each text, runs of each) gives."""
    own = [c for c in docs.columns if not (drop and c == text)]
    schema = T.StructType([*[docs.schema[c] for c in own], *fresh_fields(docs.select(*own), fields)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                words = [(t or "").encode().split() for t in part.column(text).to_pylist()]
                if key is not None:
                    words = [folded(w, "" if k is None else str(k)) for w, k in zip(words, part.column(key).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *make(words, find_runs(words))], names=schema.names)

    return in_tasks(docs, run, schema)


def with_runs(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """docs with runs, array<struct<start, length, period>> in words by (start, period), and collapsed: the text's words, of each run
    only the first period, joined by a blank. With `key`, texts are first `folded` by that column; a null key counts as the empty text."""
    fields = [T.StructField("runs", RUNS), T.StructField("collapsed", _STRING)]
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def make(words, found):
        rows = [[dict(zip(("start", "length", "period"), r)) for r in x.tolist()] for x in found]
        return [pa.array(rows, kind), pa.array([_collapsed(w, r).decode() for w, r in zip(words, found)], pa.string())]

    return _in_tasks(docs, text, key, False, fields, make)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    if len(runs):
        words = [w for w, stays in zip(words, kept_words(len(words), runs).tolist()) if stays]
    return b" ".join(words)


def summarise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """docs without the text, with n_runs, the greatest run (ties: least start, then period; nulls if there is none),
    exponent_milli, and digests of all runs and of the collapsed text. `key` as in `with_runs`."""

    def make(words, found):
        best = [min(r.tolist(), key=lambda x: (-x[1], x[0], x[2])) if len(r) else None for r in found]
        of = lambda f: pa.array([f(*b) if b else None for b in best], pa.int64())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [
            pa.array([len(r) for r in found], pa.int64()), of(lambda s, n, q: s), of(lambda s, n, q: n), of(lambda s, n, q: q), of(lambda s, n, q: 1000 * n // q),
            pa.array([sha("".join(f"{a},{b},{c}\n" for a, b, c in r.tolist()).encode()) for r in found], pa.string()),
            pa.array([sha(_collapsed(w, r)) for w, r in zip(words, found)], pa.string()),
        ]

    return _in_tasks(docs, text, key, True, [T.StructField(n, k) for n, k in SUMMARY], make)
