"""Byte-level BPE by prefix dynamic programming, with appends and edits of what is encoded.

A text is cut into pieces by the vocabulary's pattern. Of each prefix of a piece one token is the
last of its encoding: the one that ends there and fits the last token of the prefix before it, where two tokens
fit if BPE of their joined bytes gives these two. These last tokens, one for each byte, are the state:
a piece's ids are read back from its end, an append goes on from the last state, and an edit
computes only what lies between the last piece that it can't reach and the first piece that starts as one did before.

In tasks the prefixes of all new pieces of a slice grow together, byte by byte: candidates are the
tokens that the vocabulary's trie finds from each live start, and their fit is looked up or walked for all at once.

Edge cases: null reads as empty text and has no token; no text has a special meaning; repeated rows get
equal results; an empty table gives none; other columns pass through; a new column whose name is taken gets
underscores in front.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.batches import in_tasks, kept, slices, with_columns
from lectern.llm.bpe import Recent

#: Longer pieces (in bytes) are walked by themselves, so that a slice takes few steps.
TOGETHER = 192
#: Places of the table of pairs whose fit is known; a new pair takes the place of an older one.
PAIR_BITS = 20
#: Characters beyond a match's end that the pattern may look at.
AHEAD = 2
_NEVER = np.int64(1) << 40


class PairTable:
    """Numbers below 2**26 by keys below 2**37: open addressing in one array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        left = (keys.astype(np.int64) << 26) | values
        at = self._place(keys.astype(np.int64))
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several, one stays
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x1E3779B97F4A7C15)) >> np.int64(20)) & np.int64((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if there is none."""
        at = self._place(keys)
        found = self.slots[at]
        wrong = np.flatnonzero((found >> 26 != keys) & (found >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >> 26 != keys[wrong]) & (found[wrong] >= 0)]
        return np.where(found < 0, -1, found & ((1 << 26) - 1))


class PrefixEncoder:
    """Encodes by the ranks of one file (a line a token: base64 of its bytes, its rank); keeps pieces and pairs it has met."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) >= 1 << 17:
            raise ValueError("ranks are expected to be 0, 1, .. without gap, fewer than 131,072")
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.rank = ranks
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V1)
        self._grow_trie()
        self._take_apart()
        self.pieces = Recent()
        self.known_pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        self.single_pairs: dict[int, bool] = {}
        self.walked = 0  # bytes whose last token was computed

    def _grow_trie(self) -> None:
        edges: dict[int, int] = {}
        token_of = [-1]
        for rank, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                key = node << 8 | byte
                child = edges.get(key)
                if child is None:
                    child = edges[key] = len(token_of)
                    token_of.append(-1)
                node = child
            token_of[node] = rank
        self.edges, self.token_at = edges, token_of
        self.children = PairTable(np.fromiter(edges.keys(), np.int64), np.fromiter(edges.values(), np.int64))
        self.token_of = np.array(token_of, np.int64)

    def _take_apart(self) -> None:
        """The two tokens whose merge makes each token last; shorter tokens first, as their parts decide which two fit."""
        whole, lefts, rights = [], [], []
        for rank, token in enumerate(self.tokens):
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    whole.append(rank), lefts.append(left), rights.append(right)
        whole, lefts, rights = (np.array(x, np.int64) for x in (whole, lefts, rights))
        self.pairs = PairTable(lefts << 17 | rights, whole)
        later = np.maximum(lefts, rights) < whole  # two tokens may also join to one of lower rank, but none was made so
        whole, lefts, rights = whole[later], lefts[later], rights[later]
        single = self.sizes == 1
        self.born = np.where(single, -1, np.arange(len(self.tokens)))
        self.left_part, self.right_part = np.arange(len(self.tokens)), np.arange(len(self.tokens))
        self.whole = single.copy()
        for size in np.unique(self.sizes[whole]).tolist():
            of = np.flatnonzero(self.sizes[whole] == size)
            of = of[self.whole[lefts[of]] & self.whole[rights[of]]]
            made = of[self._apart(lefts[of], rights[of], whole[of])]
            self.left_part[whole[made]], self.right_part[whole[made]], self.whole[whole[made]] = lefts[made], rights[made], True
        if not self.whole.all() or single.sum() != 256:
            raise ValueError("every byte is expected to be a token, and every token to be made by merges of lower ranks")

    def _apart(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (of a rank below `before`) crosses the seam of each two tokens.

        Their merges are undone, the latest first. At each step two parts touch; their own merge would come first if its rank is below
        that of the merge that takes either part away, and at a tie if that one lies to the right.
        """
        n = len(left)
        out, open_ = np.ones(n, bool), np.arange(n)
        a, b = left.copy(), right.copy()
        until_a = np.full(n, _NEVER) if before is None else before.astype(np.int64)
        until_b = until_a.copy()
        while len(open_):
            cross = self.pairs.find(a << 17 | b)
            cross = np.where(cross < 0, _NEVER + 1, cross)
            crossed = np.where(until_a <= until_b, cross < until_a, cross <= until_b)
            out[open_[crossed]] = False
            of_a, of_b = self.born[a], self.born[b]
            go = ~crossed & (np.maximum(of_a, of_b) >= 0)
            a, b, until_a, until_b, of_a, of_b, open_ = a[go], b[go], until_a[go], until_b[go], of_a[go], of_b[go], open_[go]
            undo_a = of_a > of_b
            until_a, until_b = np.where(undo_a, of_a, until_a), np.where(undo_a, until_b, of_b)
            a, b = np.where(undo_a, self.right_part[a], a), np.where(undo_a, b, self.left_part[b])
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE of each two tokens' bytes is these two tokens."""
        pair = left << 17 | right
        at = ((pair * np.int64(0x1E3779B97F4A7C15)) >> np.int64(24)) & np.int64((1 << PAIR_BITS) - 1)
        found = self.known_pairs[at]
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            some, back = np.unique(pair[new], return_inverse=True)
            apart = self._apart(some >> 17, some & 0x1FFFF)[back]
            found[new] = pair[new] << 1 | apart
            self.known_pairs[at[new]] = found[new]
        return (found & 1).astype(bool)

    def fit(self, left: int, right: int) -> bool:
        if (known := self.single_pairs.get(pair := left << 17 | right)) is None:
            if len(self.single_pairs) >= 1 << 17:
                self.single_pairs.clear()
            known = self.single_pairs[pair] = bool(self.fits(np.array([left]), np.array([right]))[0])
        return known

    def last_tokens(self, piece: bytes, last: list[int]) -> list[int]:
        """The last token of each prefix of one piece; `last` holds those of its first prefixes already."""
        edges, token_at = self.edges, self.token_at
        begun = len(last)
        self.walked += len(piece) - begun
        live: list[tuple[int, int]] = []
        for j in range(max(0, begun - int(self.sizes.max())), len(piece)):
            live = [(i, child) for i, node in [*live, (j, 0)] if (child := edges.get(node << 8 | piece[j])) is not None]
            if j < begun:
                continue
            for i, node in live:
                token = token_at[node]
                if token >= 0 and (i == 0 or self.fit(last[i - 1], token)):
                    last.append(token)
                    break
        return last

    def _ids(self, piece: bytes, last: list[int]) -> bytes:
        out, at = [], len(piece)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return np.array(out[::-1], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian 32-bit integers, their prefixes grown together."""
        data = [p.encode() for p in pieces]
        out = {p: self._ids(d, self.last_tokens(d, [])) for p, d in zip(pieces, data) if len(d) > TOGETHER}
        order = sorted((k for k, d in enumerate(data) if len(d) <= TOGETHER), key=lambda k: -len(data[k]))
        if not order:
            return out
        flat = np.frombuffer(b"".join([data[k] for k in order]), np.uint8).astype(np.int64)
        size = np.array([len(data[k]) for k in order], np.int64)
        self.walked += len(flat)
        off = np.concatenate(([0], np.cumsum(size)[:-1]))
        last = np.full(len(flat), -1, np.int64)  # at off + j: of the prefix of j + 1 bytes
        first = start = node = np.zeros(0, np.int64)  # of each live start: where its piece begins, where it lies, how far it came
        for j in range(int(size[0])):
            active = int(np.searchsorted(-size, -j, side="left"))  # pieces of more than j bytes, which come first
            old = int(np.searchsorted(first, off[active], side="left")) if active < len(off) and j else len(first)
            first, start, node = (np.concatenate(x) for x in ((first[:old], off[:active]), (start[:old], off[:active] + j), (node[:old], np.zeros(active, np.int64))))
            child = self.children.find(node << 8 | flat[first + j])
            here = child >= 0
            first, start, node = first[here], start[here], child[here]
            token = self.token_of[node]
            ends = np.flatnonzero(token >= 0)
            token, begin, piece = token[ends], start[ends], first[ends]
            good = np.ones(len(token), bool)
            inner = np.flatnonzero(begin > piece)
            good[inner] = self.fits(last[begin[inner] - 1], token[inner])
            last[piece[good] + j] = token[good]
            order_of = np.argsort(first, kind="stable")
            first, start, node = first[order_of], start[order_of], node[order_of]
        ids = np.zeros(len(flat), "<u4")
        count = np.zeros(len(size), np.int64)
        open_, at = np.arange(len(size)), size.copy()
        while len(open_):
            token = last[off[open_] + at - 1]
            count[open_] += 1
            ids[off[open_] + size[open_] - count[open_]] = token
            at = at - self.sizes[token]
            open_, at = open_[at > 0], at[at > 0]
        blob, stop = ids.tobytes(), (off + size) * 4
        for k, a, b in zip(order, (stop - 4 * count).tolist(), stop.tolist()):
            out[pieces[k]] = blob[a:b]
        return out

    def cut(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian 32-bit integers."""
        cut = [self.cut(text) for text in texts]
        new = self.pieces.missing(set().union(*cut))
        pieces = self.pieces.now
        pieces.update(self.encode_pieces(list(new)))
        out = [b"".join(map(pieces.__getitem__, x)) for x in cut]
        self.pieces.turn(new)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def state(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids, the last token of each byte's prefix of its piece, and the character at which each piece ends."""
        return self.edit("", ([], [], []), 0, 0, text)

    def edit(self, text: str, state: tuple[list[int], list[int], list[int]], at: int, until: int, new: str) -> tuple[list[int], list[int], list[int]]:
        """The state of text[:at] + new + text[until:], from that of text; an append has at = until = len(text)."""
        ids, last, ends = state
        after = text[:at] + new + text[until:]
        shift = len(new) - (until - at)
        ends_at = np.array(ends, np.int64)
        n_kept = int(np.searchsorted(ends_at, at - AHEAD, side="right"))
        where = int(ends_at[n_kept - 1]) if n_kept else 0
        begin = len(text[:where].encode())
        id_ends = np.cumsum(self.sizes[ids]) if ids else np.zeros(0, np.int64)
        out_ids, out_last, out_ends = list(ids[: int(np.searchsorted(id_ends, begin, side="right"))]), list(last[:begin]), list(ends[:n_kept])
        starts = {0: 0} | {int(e): k + 1 for k, e in enumerate(ends)}  # where pieces began, and which
        for match in self.split.finditer(after, where):
            s = match.start()
            if s >= at + len(new) and (k := starts.get(s - shift)) is not None and k < len(ends):
                done = len(text[: s - shift].encode())
                out_ids += ids[int(np.searchsorted(id_ends, done, side="right")) :]
                out_last += last[done:]
                out_ends += [e + shift for e in ends[k:]]
                break
            piece, known = match.group().encode(), []
            if s <= at and (k := starts.get(s)) is not None and k < len(ends):
                before = text[s : min(ends[k], at)].encode()  # what the edit leaves of the piece that began here
                b = len(text[:s].encode())
                known = last[b : b + min(len(before), len(piece))]
            out_last += (own := self.last_tokens(piece, list(known)))
            out_ids += np.frombuffer(self._ids(piece, own), "<u4").tolist()
            out_ends.append(match.end())
        return out_ids, out_last, out_ends


def encoder(path: str, pattern: str) -> PrefixEncoder:
    return kept(f"prefix {path} {pattern}", lambda: PrefixEncoder(path, pattern))


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 (of what the ids decode to)."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def make():
        own = encoder(path, pattern)

        def compute(texts: pa.Array) -> list:
            found = own.encode([t or "" for t in texts.to_pylist()])
            return [
                pa.array([len(x) // 4 for x in found], pa.int64()),
                pa.array([sha(x) for x in found], pa.string()),
                pa.array([sha(own.decode(x)) for x in found], pa.string()),
            ]

        return compute

    return with_columns(docs, text, fields, make, drop=True, keeps=True)


_STATE = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "last", "ends")])


def with_state(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with a column `state` (ids, last, ends), from which `edited` goes on; a null text has the state of the empty one."""

    def make():
        own = encoder(path, pattern)
        return lambda texts: [pa.array([dict(zip(("ids", "last", "ends"), own.state(t or ""))) for t in texts.to_pylist()], _ARROW)]

    return with_columns(docs, text, [T.StructField("state", _STATE)], make, keeps=True)


_ARROW = pa.struct([(n, pa.list_(pa.int32())) for n in ("ids", "last", "ends")])


def edited(encoded: DataFrame, path: str, pattern: str, at: str = "at", until: str = "until", new: str = "new") -> DataFrame:
    """Rows (text, state, at, until, new, ..) with the new text and its state; characters from at up to until give way to new.

    Places beyond the text's end count as its end, so a large `at` appends; a null place as well. An `until` before `at` counts as `at`; null texts read as empty.
    """
    schema = encoded.schema

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = part.to_pylist()
                for row in rows:
                    text, more = row["text"] or "", row[new] or ""
                    a = len(text) if row[at] is None else min(max(row[at], 0), len(text))
                    b = len(text) if row[until] is None else min(max(row[until], a), len(text))
                    state = tuple(row["state"][n] for n in ("ids", "last", "ends"))
                    row["state"] = dict(zip(("ids", "last", "ends"), own.edit(text, state, a, b, more)))
                    row["text"] = text[:a] + more + text[b:]
                yield pa.RecordBatch.from_pylist(rows, part.schema)

    return in_tasks(encoded, run, schema, keeps=True)
