import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import prefix_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = prefix_bpe.PrefixEncoder(PATH, PATTERN)
sha = lambda x: hashlib.sha256(x).hexdigest()


def same(texts):
    for text, ids in zip(texts, ENCODER.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text), text
        assert ENCODER.decode(ids) == text.encode()


def test_special_cases():
    same(
        [
            "", " ", "\n\n", "Hello WORLD's it'LL don't", "<|endoftext|>x", "\x1c a\x1db\x85c\xa0d  \x1f", "'re're're '", "a" * 3000, "x" * 500 + " " * 400 + "y", "!" * 700, "١٢٣ ² Ⅷ ½",
            "漢字かな交じり文", "😀😀 👨‍👩‍👧", "a­b", "\x00\x01 \x7f", "ab" * 20_000, "᠎ ​  ",
        ]
    )


def test_every_character_by_class():
    """The pattern's classes are those of the library, for all characters that both know."""
    import unicodedata

    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    for at in range(0, len(known), 4000):
        text = "a" + "a".join(known[at : at + 4000])
        assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    same(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abetn' s\n1.é", max_size=80), max_size=8))
def test_near_text(texts):
    same(texts)


def test_fit_is_what_merging_says():
    """Two tokens fit if, and only if, the library's encoding of their bytes is these two."""
    r = random.Random(1)
    few = [r.randrange(len(RANKS)) for _ in range(3000)]
    pairs = [(a, b) for a, b in zip(few, few[1:])] + [(r.randrange(600), r.randrange(600)) for _ in range(3000)]
    left, right = (np.array(x) for x in zip(*pairs))
    for (a, b), fits in zip(pairs, ENCODER.fits(left, right).tolist()):
        assert fits == (LIBRARY._encode_single_piece(ENCODER.tokens[a] + ENCODER.tokens[b]) == [a, b])


def full(text):
    ids, last, ends = ENCODER.state(text)
    assert ids == LIBRARY.encode_ordinary(text)
    return ids, last, ends


@settings(max_examples=300, deadline=None)
@given(st.text("ab' rel\n1.é ", max_size=40), st.text("ab' rel\n1.é ", max_size=12), st.integers(0, 40), st.integers(0, 40))
def test_edits(text, new, at, size):
    at = min(at, len(text))
    until = min(at + size, len(text))
    assert ENCODER.edit(text, full(text), at, until, new) == full(text[:at] + new + text[until:])


def test_an_edit_computes_what_is_near():
    text = " ".join(f"word{i} other" for i in range(5000))
    state = full(text)
    for at, until, new in ((20_000, 20_003, "xyz abc"), (len(text), len(text), " more"), (0, 1, "W")):
        before = ENCODER.walked
        after = ENCODER.edit(text, state, at, until, new)
        assert ENCODER.walked - before < 60
        assert after == full(text[:at] + new + text[until:])
    long = "x" * 4000
    state, before = full(long), ENCODER.walked
    assert ENCODER.edit(long, state, 4000, 4000, "xx")[1] == full(long + "xx")[1]
    assert ENCODER.walked - before == 2 + 4002  # the appended bytes; then the whole text, to compare


def test_other_files_are_refused(tmp_path):
    rows = open(PATH, "rb").read().splitlines()
    for odd in (rows[1:], rows[:200], rows[:256] + [base64.b64encode(b"abcdefg") + b" 256"]):
        (tmp_path / "odd").write_bytes(b"\n".join(odd))
        with pytest.raises(ValueError):
            prefix_bpe.PrefixEncoder(str(tmp_path / "odd"), PATTERN)


def test_documents(odd_docs, no_docs):
    out = prefix_bpe.encode_and_decode(odd_docs.select("doc_id", "text", "source"), PATH, PATTERN)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for r in odd_docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, r.source, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert prefix_bpe.encode_and_decode(no_docs, PATH, PATTERN).count() == 0


def test_states_and_edits_of_rows(spark, no_docs):
    rows = [(1, "one two", 3, 4, " and"), (2, None, 0, 0, "new"), (3, "tail", 99, None, "s"), (4, "cut it", 0, 99, None), (5, "back", 3, 1, "x"), (6, "end", None, None, "less")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, until int, new string")
    out = prefix_bpe.edited(prefix_bpe.with_state(docs, PATH, PATTERN), PATH, PATTERN)
    got = {r.doc_id: r for r in out.collect()}
    texts = {1: "one andtwo", 2: "new", 3: "tails", 4: "", 5: "bacxk", 6: "endless"}
    for k, text in texts.items():
        assert got[k].text == text
        assert (got[k].state.ids, got[k].state.last, got[k].state.ends) == full(text)
    taken = prefix_bpe.with_state(docs.withColumn("state", docs.doc_id), PATH, PATTERN)
    assert taken.columns[-2:] == ["state", "_state"]
    assert prefix_bpe.with_state(no_docs, PATH, PATTERN).count() == 0
