import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import registry, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries=256, rounds=4, parts=4):
    """Lloyd's rounds by all distances, in plain integers: {position: (code, error)}, digest. rows: (vec_id, vector) that are kept."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    x = np.array([[math.floor(1024 * v) for v in r[1]] for r in rows], dtype=object)
    width, codes, error, flat = x.shape[1] // parts, [], 0, []
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        book = [list(own[k]) for k in order[:entries]]
        for step in range(rounds + 1):
            far = [[sum((a - b) ** 2 for a, b in zip(v, e)) for e in book] for v in own]
            code = [d.index(min(d)) for d in far]
            if step < rounds:
                for e in range(len(book)):
                    members = [own[k] for k in range(len(own)) if code[k] == e]
                    if members:
                        book[e] = [sum(m[i] for m in members) // len(members) for i in range(width)]
        codes.append(code)
        error = [d[c] + (error[k] if error else 0) for k, (d, c) in enumerate(zip(far, code))]
        flat += [v for e in book for v in e]
    return [("".join(f"{c[k]:02x}" for c in codes), int(error[k])) for k in range(len(rows))], hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def vectors(n, dim, seed=1, grid=None):
    r = np.random.default_rng(seed)
    x = r.integers(-grid, grid + 1, (n, dim)) / 1024 if grid else r.normal(0, 0.2, (n, dim))
    return [[float(np.float32(v)) for v in row] for row in x]


@pytest.mark.parametrize("n, dim, entries, grid", [(300, 8, 16, None), (400, 8, 20, 2), (90, 4, 256, 1), (60, 8, 7, 3)])
def test_equals_plain_rounds(spark, n, dim, entries, grid):
    """A coarse grid has ties and repeated vectors everywhere."""
    rows = [(k * 7 % n, v, k % 3) for k, v in enumerate(vectors(n, dim, grid=grid))]
    coded = vector_codes.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries)
    want, digest = plain([r[:2] for r in rows], entries)
    assert sorted((r.vec_id, r.label, r.code, r.error) for r in coded.rows.collect()) == sorted((r[0], r[2], *w) for r, w in zip(rows, want))
    assert vector_codes.digest(coded.books) == digest


def test_bounds_spare_distances(spark):
    rows = [(k, v, 0) for k, v in enumerate(vectors(3000, 16))]
    coded = vector_codes.encode(spark.createDataFrame(rows, SCHEMA), entries=64)
    assert coded.distances[0] == 3000 * 4 * 64
    assert max(coded.distances[1:]) < coded.distances[0] / 3


def test_bounds_hold():
    """After each round: upper bounds are above the distance to the own entry, lower ones below that to each entry."""
    r = np.random.default_rng(3)
    x = r.integers(-300, 300, (500, 4))
    book = vector_codes.Book(x[:40].copy(), np.zeros(40))
    bounds = vector_codes.first_bounds(x, book)
    for _ in range(6):
        book = book.after(np.array([x[bounds.code == e].sum(0) // max(1, (bounds.code == e).sum()) if (bounds.code == e).any() else book.entries[e] for e in range(40)]))
        true = np.sqrt(vector_codes.squared(x, book.entries))
        assert (bounds.upper + book.moved[bounds.code] >= true[np.arange(500), bounds.code]).all()
        assert (bounds.lower * bounds.step.astype(float)[:, None] - book.moved <= true).all()
        bounds, _ = vector_codes.next_bounds(x, book, bounds)
        assert bounds.code.tolist() == vector_codes.squared(x, book.entries).argmin(1).tolist()


def test_odd_rows(spark):
    fine = vectors(20, 4, seed=2)
    odd = [None, [], [None, 1.0, 2.0, 3.0], [math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [1.0] * 8]
    rows = [(k, v, k % 2 or None) for k, v in enumerate(fine)] + [(100 + k, v, 5) for k, v in enumerate(odd)] + [(None, fine[0], None), (3, fine[3], 1), (3, fine[3], 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit("taken"), "_x": F.lit(1), "_0": F.lit(2)})
    coded = vector_codes.encode(docs)
    assert (coded.code, coded.error, coded.rows.columns) == ("_code", "_error" if "error" in docs.columns else "error", ["vec_id", "label", "code", "_x", "_0", "_code", "error"])
    kept = [r for r in rows if r[1] and len(r[1]) == 4 and None not in r[1] and all(map(math.isfinite, r[1]))]
    want, digest = plain([r[:2] for r in kept])
    want = [(str(r[0]), str(r[2]), *map(str, w)) for r, w in zip(kept, want)] + [("101", "5", "None", "None"), ("105", "5", "None", "None")]
    assert sorted((str(r.vec_id), str(r.label), str(r._code), str(r.error)) for r in coded.rows.collect()) == sorted(want)
    assert vector_codes.digest(coded.books) == digest
    for many in (100, 0):
        sums = {}
        for r in vector_codes.with_label_error(coded.rows, "label", "error", many=many).collect():
            sums.setdefault(r.label, set()).add(r.label_error)
        whole = {label: sum(int(w[3]) for w in want if w[1] == str(label) and w[3] != "None") for label in (None, 1)}
        assert sums == {label: {n} for label, n in whole.items()} | {5: {None}}


def test_none_and_wrong(spark):
    none = spark.createDataFrame([], SCHEMA)
    coded = vector_codes.encode(none)
    assert (coded.rows.columns, coded.rows.count(), coded.books) == (["vec_id", "label", "code", "error"], 0, [])
    assert vector_codes.with_label_error(coded.rows, "label", "error").count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 6, 0)], SCHEMA))
    with pytest.raises(Exception, match="too large"):
        vector_codes.encode(spark.createDataFrame([(1, [1e9] * 4, 0)], SCHEMA))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = plain(rows[:0] or rows, rounds=4)
    got = {r.vec_id: (r.code, r.error, r.codebooks_sha256) for r in registry.QUERIES["op13_vector_codes"](spark, sf).collect()}
    assert got == {r[0]: (*w, digest) for r, w in zip(rows, want)}
