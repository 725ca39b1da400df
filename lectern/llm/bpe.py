"""BPE encoding and decoding by prefix-sharing trie traversal.

For BPE, the last token of a text's prefix follows from the last tokens of its shorter
prefixes: it is the one token that ends there and is compatible with the last token of what
comes before it. So distinct words are put in order, which is a trie walked depth first; the
last-token states of a shared prefix are computed once and stay on a stack while the walk is
below it. A state is computed when a token that could come after it asks for it, most are never asked for.
A word's tokens are read back from its end. The cost is linear in a word's length.

Vocabularies: files of the tokenizers library whose model is BPE, here with lower-casing,
white space dropped and an end-of-word mark. Decoding joins the tokens' names by blanks, as
the library does for a file without decoder. Files of another kind are refused.

Edge cases: null reads as empty text and has no token; special tokens' names in a text become
their ids; repeated rows get equal results; other columns pass through; a new column whose name is taken
gets underscores in front.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lectern.llm.batches import fresh_fields, in_tasks, kept, with_columns

#: Encoded pieces (and words) that a task keeps of the last two turns, each at most, and their characters; longer ones hardly come twice.
KEPT, KEPT_CHARACTERS = 80_000, 64
#: Pairs of tokens whose compatibility a task keeps.
KEPT_PAIRS = 200_000
#: Letters of a word from which on its states are computed from its beginning, as one that asks for another asks no deeper than so many.
DEEP = 200
#: White space to Python, but not to the vocabulary's pattern.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = regex.compile(r"(?V1)[\s--\x1c-\x1f]+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be seen, else one from 256 on, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class Recent:
    """A bounded dictionary: what was not asked for during a whole turn goes."""

    def __init__(self, most: int = KEPT):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.most = most

    def missing(self, keys: set[str]) -> set[str]:
        """Those keys that are not known; the others are in `now` from here on."""
        unknown = keys - self.now.keys()
        for key in unknown & self.before.keys():
            self.now[key] = self.before[key]
        return unknown - self.before.keys()

    def turn(self, new: set[str]) -> None:
        """The end of a turn in which `new` came in."""
        for key in new:
            if len(key) > KEPT_CHARACTERS:
                del self.now[key]
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now


def check_vocabulary(spec: dict, kind: dict) -> None:
    """Raises unless the file's parts are those that the walk is written for."""
    model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    found = {"normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"], "post_processor": spec["post_processor"]}
    odd = [k for k, v in plain.items() if model.get(k) != v] + [k for k, v in kind.items() if found[k] != v]
    odd += ["added_tokens" for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"this vocabulary is of another kind: {', '.join(sorted(set(odd)))}")


#: What the files of word vocabularies have besides the model. The pattern may be any.
def _word_vocabulary(spec: dict) -> dict:
    normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": steps[0].get("pattern"), "behavior": "Removed", "invert": True}
    letters = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    return {"normalizer": {"type": "Sequence", "normalizers": normal}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, letters]}, "post_processor": None}


class TrieEncoder:
    """Encodes words of one vocabulary file; keeps the compatibility of token pairs it has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_vocabulary(spec, _word_vocabulary(spec))
        if spec["decoder"] is not None:
            raise ValueError("this vocabulary is of another kind: decoder")
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = np.array([""] * (max([*self.vocab.values(), *self.special.values()]) + 1), dtype=object)
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.longest = max(len(x.removesuffix(self.end)) for x in self.vocab)
        self.letters = byte_letters()
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.decimals = np.array([str(i) for i in range(len(self.names))], dtype=object)
        self.sizes = [len(x.removesuffix(self.end)) if self.end else len(x) for x in self.names]
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.pieces, self.known = Recent(), Recent()
        self.library = Tokenizer.from_str(json.dumps(spec))

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short run: the pair of lowest rank first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def whole(self, token: int) -> bool:
        """Whether BPE of the token's text is the token."""
        if (known := self._whole.get(token)) is None:
            name = self.names[token]
            known = self._whole[token] = self.merged(self.symbols(name)) == [name]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' text is these two tokens."""
        if len(self._fits) > KEPT_PAIRS:
            self._fits.clear()
        pair = [self.names[left], self.names[right]]
        known = self._fits[left << 20 | right] = self.merged(self.symbols(pair[0]) + self.symbols(pair[1])) == pair
        return known

    def last(self, text: str, upto: int, states: list[int | None], ending: str) -> int:
        """The last token of text[:upto]; states[i] is that of text[:i], filled in where it is asked for. `ending` marks the end of a word."""
        vocab, fits, start = self.vocab.get, self._fits.get, upto - self.longest
        if start <= 0:
            token = vocab(text[:upto] + ending)
            if token is not None and self.whole(token):
                return token
            start = 1
        for i in range(start, upto):
            token = vocab(text[i:upto] + ending)
            if token is not None:
                left = states[i]
                if left is None:
                    left = states[i] = self.last(text, i, states, "")
                known = fits(left << 20 | token)
                if known or known is None and self.fits(left, token):
                    return token
        raise ValueError(f"no token ends {text[:upto]!r}")

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word (in byte letters) as 32-bit integers. The sorted words are the trie, walked depth first."""
        out, states, before, sizes = {}, [-1], "", self.sizes
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word), len(states) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            states[shared + 1 :] = [None] * (len(word) - shared - 1)
            if len(word) > DEEP:
                for i in range(shared, len(word)):
                    if states[i] is None:
                        states[i] = self.last(word, i, states, "")
            token = self.last(word, len(word), states, self.end)
            ids, at = [token], len(word) - sizes[token]
            while at:
                token = states[at]
                ids.append(token)
                at -= sizes[token]
            out[word] = struct.pack(f"<{len(ids)}i", *reversed(ids))
            before = word
        return out

    def normal(self, text: str) -> str:
        """As the file's normalizer has it; Latin text by Python's own functions, other scripts by the library's tables."""
        if text.isascii():
            return text.lower()
        if _BEYOND_LATIN.search(text):
            return self.library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).lower()

    def cut(self, text: str) -> list[str]:
        """Runs without white space of one text between special tokens; no token crosses white space."""
        text = self.normal(text)
        if _SEPARATORS.search(text) or _BEYOND_LATIN.search(text):
            return [x for x in _BLANKS.split(text) if x]
        return text.split()

    def words(self, piece: str) -> list[str]:
        """The words of a piece in byte letters."""
        if piece.isascii():
            if piece.isalpha():
                return [piece]
            if piece[:-1].isalpha() and piece[-1] in ",.;:!?":
                return [piece[:-1], piece[-1]]
        if _BEYOND_LATIN.search(piece):
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        found = self.split.findall(piece)
        return found if piece.isascii() and piece.isprintable() else ["".join([self.letters[b] for b in w.encode()]) for w in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            if any(name in text for name in self.special):
                parts = self.special_split.split(text)
                cut.append([x for i, p in enumerate(parts) for x in ([p] if i % 2 else self.cut(p))])
            else:
                cut.append(self.cut(text))
        new = self.pieces.missing(set().union(*cut))
        words_of = {piece: self.words(piece) for piece in new if piece not in self.special}
        fresh = self.known.missing(set().union(*words_of.values()))
        self.known.now.update(self.encode_words(fresh))
        known, pieces = self.known.now.__getitem__, self.pieces.now
        for piece, words in words_of.items():
            pieces[piece] = known(words[0]) if len(words) == 1 else b"".join(map(known, words))
        for name, i in self.special.items():
            pieces[name] = struct.pack("<i", i)
        out = [b"".join(map(pieces.__getitem__, x)) for x in cut]
        self.known.turn(fresh)
        self.pieces.turn(new)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.names[ids].tolist())


    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        """The number of ids, and SHA-256 of their decimal form and of what they decode to."""
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return len(ids), sha(" ".join(self.decimals[ids].tolist())), sha(self.decode(ids))


def encoder(path: str) -> TrieEncoder:
    return kept(f"trie {path}", lambda: TrieEncoder(path))


def _lists(found: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))


_IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids, array<int>."""

    def make():
        own = encoder(path)
        return lambda texts: [_lists(own.encode([t or "" for t in texts.to_pylist()]))]

    return with_columns(docs, text, [T.StructField(ids, _IDS)], make, keeps=True)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", digests: bool = False) -> DataFrame:
    """decode(encode(docs)) in one pass: half the Python workers, and ids go to the JVM once.

    With `digests`, none goes there: n_tokens, ids_sha256 (of the decimal ids joined by a blank) and
    decoded_sha256 (of the decoded text) stand in place of text, ids and decoded.
    """
    if digests:
        fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        fields = [T.StructField(ids, _IDS), T.StructField(decoded, T.StringType())]

    def make():
        own = encoder(path)

        def compute(texts: pa.Array) -> list:
            found = own.encode([t or "" for t in texts.to_pylist()])
            if not digests:
                return [_lists(found), pa.array([own.decode(np.frombuffer(x, "<i4")) for x in found], pa.string())]
            rows = [own.digests(np.frombuffer(x, "<i4")) for x in found]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

        return compute

    return with_columns(docs, text, fields, make, drop=digests, keeps=True)


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with a column of the text that its ids stand for; a null array reads as empty."""
    schema = T.StructType([*encoded.schema.fields, *fresh_fields(encoded, [T.StructField(decoded, T.StringType())])])

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(ids)
                flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
                texts = [own.decode(flat[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return in_tasks(encoded, run, schema, keeps=True)
