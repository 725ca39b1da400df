import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import periodic

from .conftest import prose


def brute(words, least=6, times=4):
    """All (start, length, period), from each period by itself."""
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                s = words[i : j + q]
                if not any(all(s[x] == s[x + d] for x in range(len(s) - d)) for d in range(1, q)):
                    out.add((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def summary(text, key):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(key).encode() if key is not None else b""), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests)


few = st.lists(st.integers(0, 3), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(few, few, st.integers(0, 9)), max_size=4))
def test_any_words(parts):
    texts = [a + (b * k) + a for a, b, k in parts]
    assert [[tuple(x) for x in g.tolist()] for g in periodic.find_runs(texts)] == [brute(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(few, few, st.integers(0, 5), st.integers(2, 5))
def test_method_alone_finds_runs_of_any_exponent(a, b, k, times):
    """The tree by itself, without what is left out before, also where two periods are enough."""
    text = a + b * k + a
    assert [tuple(x) for x in periodic.runs_of(np.array(text, np.int64), 2, times).tolist()] == brute(text, 2, times)


def test_squares_come_from_links():
    """A square whose only leftmost places are covered by a rotation elsewhere: without the walk it isn't found."""
    r = random.Random(5)
    lost = 0
    for _ in range(300):
        text = np.array([r.randrange(2) for _ in range(30)], np.int64)
        tree = periodic.SuffixTree(text)
        start, half = periodic.covering(tree, periodic.blocks(tree))
        own = {(int(h), tuple(text[s : s + 2 * h])) for s, h in zip(start, half)}
        first, size = periodic.vocabulary(tree, start, half)
        places = tree.order[first]
        found = {(int(h), tuple(text[s : s + 2 * h])) for s, h in zip(places, size)}
        every = {(h, tuple(text[s : s + 2 * h])) for s in range(30) for h in range(1, (30 - s) // 2 + 1) if (text[s : s + h] == text[s + h : s + 2 * h]).all()}
        assert found == every
        lost += len(every - own)
    assert lost > 0


def test_blocks():
    text = [0, 1, 0, 1, 0, 2, 0, 1, 0, 2, 2]
    assert periodic.blocks(periodic.SuffixTree(np.array(text))).tolist() == [0, 1, 2, 5, 6, 10]


def test_long_texts():
    r = random.Random(2)
    words = [r.randrange(50) for _ in range(900)]
    text = words[:300] + words[:200] * 5 + [7] * 900 + words + [1, 2] * 300
    got = [tuple(x) for x in periodic.find_runs([text])[0].tolist()]
    assert got == brute(text)
    assert len(got) == 3


TEXTS = ["", None, " \t\n\x0b ", "a", "a " * 5, "a " * 6, "x y " * 4, "x y z " * 3 + "x y", "x y z " * 4, "é é é é é é", "a b " * 7, "a b\n" * 6 + "c " * 9, prose(1, 400) + " la" * 30, prose(3, 2000)]


def test_rows(spark, odd_rows, odd_docs, no_docs):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(k, prose(k, 60)) for k in range(100, 260)] + [(None, "a b c " * 9), (1, "a"), (1, "a")]
    out = periodic.summarise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), key="doc_id")
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((k, *summary(t, k))) for k, t in rows)
    folded = [k for k, _ in rows if k is not None and zlib.crc32(str(k).encode()) % 10 == 0]
    assert folded
    docs = odd_docs.where("doc_id is null or doc_id not in (6, 7)")
    got = periodic.summarise(docs, key="doc_id").drop("lang", "source", "n_chars").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *summary(r[1], r[0]))) for r in odd_rows if r[0] not in (6, 7))
    assert periodic.summarise(no_docs, key="doc_id").count() == 0


def test_runs_and_collapsed_texts(spark, no_docs):
    rows = [(1, "say it " * 5 + "once", 9), (2, None, 9), (3, "no run", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = periodic.with_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "_runs", "collapsed"]
    got = {r.doc_id: ([tuple(x) for x in r._runs], r.collapsed) for r in out.collect()}
    assert got == {1: ([(0, 10, 2)], "say it once"), 2: ([], ""), 3: ([], "no run")}
    assert periodic.with_runs(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 30, 31, 1024])
def test_least_factors(n):
    assert periodic.least_factors(n)[2:].tolist() == [next(d for d in range(2, k + 1) if k % d == 0) for k in range(2, n + 1)]
