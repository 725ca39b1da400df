import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.TrieEncoder(PATH)


def same(texts):
    for text, ids, want in zip(texts, ENCODER.encode(texts), LIBRARY.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(ids, "<i4")
        assert ids.tolist() == want.ids, text
        assert ENCODER.decode(ids) == LIBRARY.decode(want.ids, skip_special_tokens=False), text


def test_special_cases():
    same(
        [
            "", " ", "Hello WORLD's it'LL don't", "<|startoftext|>x <|endoftext|>", "<|endoftext|><|endoftext|>", "ΑΣ Σ ΣΑΣ", "İstanbul ſ K", "é Å ﬁ", "\x1c a\x1db\x85c\xa0d",
            "١٢٣ ² Ⅷ ½", "😀😀 👨‍👩‍👧", "!" * 500, "a" * 3000, "漢字かな", "a­b", "'s's", "\x00\x01 \x7f", "x" * 50_000,
        ]
    )


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    same(texts)


def test_memory_is_bounded():
    r = random.Random(3)
    own = bpe.TrieEncoder(PATH)
    own.pieces.most = own.known.most = 50
    for _ in range(20):
        texts = [" ".join("".join(r.choice("abcde") for _ in range(6)) for _ in range(40)) for _ in range(3)]
        got = own.encode(texts)
        assert [np.frombuffer(x, "<i4").tolist() for x in got] == [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
        assert len(own.pieces.now) <= 50
    same(["x" * 5000 + " word", "y" * 65 + " " + "z" * 64])
    for known in (ENCODER.pieces, ENCODER.known):
        assert max(map(len, known.now)) <= bpe.KEPT_CHARACTERS


def test_most_states_are_never_computed(monkeypatch):
    r, asked = random.Random(4), []
    last = bpe.TrieEncoder.last
    monkeypatch.setattr(bpe.TrieEncoder, "last", lambda self, text, upto, states, ending: asked.append(upto) or last(self, text, upto, states, ending))
    words = {"".join(r.choice(["tra", "lo", "ben", "ish", "qu", "er", "x"]) for _ in range(5)) for _ in range(300)}
    same([" ".join(sorted(words))])
    letters = len({word[:i] for word in words for i in range(1, len(word) + 1)}) + len(words)
    assert len(words) <= len(asked) < letters / 2


def test_words_about_the_depth():
    r = random.Random(5)
    for of in ("x", "ab", "traloben", "é", "漢字"):
        for n in (bpe.DEEP - 1, bpe.DEEP, bpe.DEEP + 1, 5 * bpe.DEEP):
            word = "".join(r.choice(of) for _ in range(n))
            same([f"{word} {word[: n // 2]} {word[: n // 2]}s {word[:-1]} {word}{word[:9]}"])


@pytest.mark.parametrize("part, value", [("normalizer", None), ("post_processor", {"type": "x"}), ("decoder", {"type": "ByteLevel"}), ("model", {"dropout": 0.1})])
def test_other_files_are_refused(tmp_path, part, value):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec[part] = spec[part] | value if part == "model" else value
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="dropout" if part == "model" else part):
        bpe.TrieEncoder(str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        token_files.Encoder(PATH)


def test_names_that_are_taken(odd_docs):
    docs = odd_docs.withColumnRenamed("source", "ids").withColumnRenamed("lang", "decoded").where("doc_id = 8")
    out = bpe.encode_and_decode(docs, PATH)
    assert out.columns == [*docs.columns, "_ids", "_decoded"] and out.first()["_decoded"]
    assert bpe.decode(bpe.encode(docs, PATH), PATH, "_ids").columns == out.columns


def test_operator(odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("source", "tokens")
    for out in (bpe.decode(bpe.encode(docs, PATH), PATH), bpe.encode_and_decode(docs, PATH)):
        assert out.columns == [*docs.columns, "ids", "decoded"]
        for r in out.collect():
            want = LIBRARY.encode(r.text or "", add_special_tokens=False)
            assert r.ids == want.ids and r.decoded == LIBRARY.decode(want.ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0


def test_query(spark):
    from lectern.llm.registry import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op3_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        want = LIBRARY.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), sha(" ".join(map(str, want))))
        assert r.decoded_sha256 == sha(LIBRARY.decode(want, skip_special_tokens=False))


