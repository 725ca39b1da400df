"""Words and shingles of many texts at once, as 64-bit hashes in flat arrays.

A word is a maximal run of letters and digits of the lower-cased text. Hashes depend
on the word alone, so they agree between tasks, machines and runs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        steps = np.full(n, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _POWERS[kind] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[kind][:n]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, lower case, other characters as blanks
    offsets: np.ndarray  # of each text in data
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # of each text, its first word; one entry more than texts
    sums: np.ndarray  # running sums from which any piece's hash follows

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        start, end = (self.start, self.end) if start is None else (start, end)
        down = _powers("down", len(self.data) + 1)
        return mixed((self.sums[end] - self.sums[start]) * down[start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null reads as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _plain(data: np.ndarray) -> bool:
    """Whether all characters beyond ASCII are Latin-1 letters."""
    high = np.flatnonzero(data >= 0xC0)
    return not len(high) or bool((data[high] == 0xC3).all() and not np.isin(data[high + 1], (0x97, 0xB7)).any())


def words_of(texts: pa.Array) -> Words:
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    data, offsets = buffers(low)
    if not _plain(data):
        data, offsets = buffers(pc.replace_substring_regex(low, r"[^\p{L}\p{N}]", " "))
    letter = _LETTERS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:-1]
    end = letter.copy()
    end[:-1] &= ~letter[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data)), out=sums[1:])
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), sums)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets by text) of `size` consecutive words; a text of fewer words has one shingle of all its words."""
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(made)))
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], made) + np.repeat(first[:-1], made)
    length = np.repeat(np.minimum(counts, size), made)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    total = mixed(length.astype(np.uint64))
    for j in range(size):
        step = padded[place + j] * mixed(np.uint64([j + 1]))
        total = mixed(total + (step if j == 0 else np.where(length > j, step, np.uint64(0))))
    return total, offsets


def shingles_of(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets by text), repeats included.

    A text with no word but some other character has one shingle, the text itself; null and empty texts have none.
    """
    w = words_of(texts)
    shingles, offsets = shingle_hashes(w.hashes(), w.first, size)
    bare = [i for i in np.flatnonzero(w.counts() == 0) if (texts[i].as_py() or "") != ""]
    if not bare:
        return shingles, offsets
    own = [int.from_bytes(hashlib.blake2b(texts[i].as_py().encode(), digest_size=8).digest(), "little") for i in bare]
    shingles = np.insert(shingles, offsets[bare], np.array(own, np.uint64))
    more = np.zeros(len(offsets), np.int64)
    more[np.array(bare) + 1] = 1
    return shingles, offsets + np.cumsum(more)
