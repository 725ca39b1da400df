"""Operators that learn: toxicity, language, cross-entropy difference."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import language, lm_score, toxicity
from lectern.llm.registry import QUERIES

from .conftest import SCHEMA, prose

DATA = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_documents(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = QUERIES["op1_toxicity"](spark, DATA).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    good, bad = [s for s, t in held if t == 0], [s for s, t in held if t == 1]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.9
    assert np.mean([(s >= 0.5) == t for s, t in held]) > 0.93


def test_toxicity_edge_cases(spark, odd_docs, no_docs):
    label = "doc_id bigint, toxic int, note string"
    none = spark.createDataFrame([], label)
    for docs in (odd_docs.withColumnRenamed("source", "features").withColumnRenamed("lang", "prediction"), no_docs):
        out = toxicity.score(docs, toxicity.fit(docs, none))
        assert out.columns == [*docs.columns, "score"] and all(r.score == 0.0 for r in out.collect())
    one_kind = spark.createDataFrame([(1, 1, "x"), (None, 0, "x"), (2, None, "x"), (999, 0, "x")], label)
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, one_kind)).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1, "x"), (1, 0, "y"), (6, 0, "x"), (13, 0, None), (4, 0, "x")], label)
    docs = odd_docs.withColumnRenamed("source", "features").withColumnRenamed("lang", "prediction")
    out = toxicity.score(docs, toxicity.fit(docs, both)).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 10}) == 1


def test_toxicity_features():
    row = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(pa.array([text]), np.zeros(0, np.uint64), np.zeros(0))[0]))
    x = row("You IDIOT! What a nice day")
    assert x["insult_density"] == pytest.approx(1 / 6) and x["near_second_person"] == pytest.approx(1 / 6) and x["second_person"] == pytest.approx(1 / 6)
    assert row("what an 1d1ot he is, an i.d.i.o.t")["disguised"] > 0 and row("what an id1ot")["disguised_insults"] > 0
    assert row("SHOUTING now")["capital_words"] > 0.5
    assert not any(row(None).values()) and not any(row("").values())


@pytest.mark.parametrize("seed", range(4))
def test_toxicity_features_against_plain_counts(seed):
    r = np.random.default_rng(seed)
    pool = ["you", "Your", "IDIOT", "moron", "calm", "Tisch", "été", "dich", "SHOUT", "x!", "a.b", "LOSER!!", "ok,", "trash", "die", "1", "Über"]
    text = " ".join(r.choice(pool, 60))
    got = dict(zip(toxicity.FEATURES, toxicity.features(pa.array([text]), np.zeros(0, np.uint64), np.zeros(0))[0]))
    words = re.findall(r"[^\W_]+", text.lower())
    insult, you = [w in toxicity.INSULTS for w in words], [w in toxicity.SECOND_PERSON for w in words]
    near = [insult[i] and any(you[max(0, i - toxicity.NEAR_WORDS) : i + toxicity.NEAR_WORDS + 1]) for i in range(len(words))]
    raw = text.encode()
    want = {
        "insult_density": sum(insult) / len(words), "second_person": sum(you) / len(words), "near_second_person": sum(near) / len(words),
        "hit_words": math.log1p(sum(insult)), "peak": max(sum(insult[i : i + toxicity.WINDOW_WORDS]) for i in range(len(words))) / toxicity.WINDOW_WORDS,
        "capitals": sum(65 <= b <= 90 for b in raw) / len(raw), "exclamations": raw.count(b"!") / len(raw),
        "capital_words": sum(len(x) for x in re.findall(rb"[A-Z]{3,}", raw)) / len(raw), "log_words": math.log1p(len(words)),
        "word_length": sum(len(w.encode()) for w in words) / len(words), "learned_density": 0.0, "learned_weight": 0.0,
        "punctuation": sum(chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for b in raw) / len(raw),
    }
    assert {k: got["learned_peak" if k == "peak" else k] for k in want} == pytest.approx(want)


def test_calibration_is_learned_apart(spark, monkeypatch):
    """Rows that calibrate teach neither lexicon nor trees, and the calibrated score never falls where the trees' margin rises."""
    bad = lambda i: i % 4 == 0
    docs = spark.createDataFrame([(i, prose(i, 30) + (" gruntle" * 2 if bad(i) else "")) for i in range(800)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(bad(i))) for i in range(800)], "doc_id bigint, toxic int")
    learned, plain = [], toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda rows: learned.append({r.pick for r in rows.collect()}) or plain(rows))
    model = toxicity.fit(docs, labels)
    assert 400 < len(learned[0]) < 750 and not any((p >> 8) % 4 == 0 for p in learned[0])
    limits, values = model.calibration.boundaries.toArray().tolist(), model.calibration.predictions.toArray().tolist()
    assert limits == sorted(limits) and values == sorted(values)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i in scores if bad(i)) > 0.5 > max(scores[i] for i in scores if not bad(i))


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op7_language"](spark, DATA).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean(held) > 0.97


def test_language_edge_cases(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("source", "pick")
    model = language.fit(docs)
    rows = {(r.doc_id, r.text): r for r in language.identify(docs.drop("lang"), model).collect()}
    for (doc_id, text), r in rows.items():
        lettered = any(c.isalpha() for c in text or "")
        assert (r.lang_pred in {"en", "de", "fr", "es"}) == lettered and (lettered or (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True))
    assert language.identify(no_docs, model).count() == 0
    empty = language.fit(no_docs)
    assert {r.lang_pred for r in language.identify(docs.drop("lang"), empty).collect()} == {"und"}


def test_language_against_plain_cosines(spark, odd_docs):
    """n-grams, TF-IDF and cosines by plain loops, for the same document frequencies and centroids."""
    model = language.fit(odd_docs)
    texts = [r.text for r in odd_docs.where("length(text) < 3000").collect()] + ["Ωμέγα und Straße 12 à-la"]
    names, scores, _ = model.identify(pa.array(texts))
    for text, name, score in zip(texts, names, scores):
        data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        found = Counter()
        for size in language.SIZES:
            for i in range(len(data) - size + 1):
                code = int.from_bytes(bytes([size]) + data[i : i + size], "big")
                found[(code * int(language._MIX)) % 2**64 >> (65 - language.DIMENSIONS.bit_length())] += 1
        v = {k: math.log1p(n) * float(model.idf[k]) for k, n in found.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        like = [sum(x * float(c[k]) for k, x in v.items()) / length for c in model.centroids]
        if any(c.isalpha() for c in text):
            assert score == pytest.approx(max(like), abs=1e-4) and like[[n for n in range(len(like)) if model.names[n] == name][0]] <= max(like) + 1e-9
            assert max(x for x, n in zip(like, model.names) if n == name) == pytest.approx(max(like), abs=1e-4)
        else:
            assert (name, score) == ("und", 0)


def test_language_sample_of_repeated_rows(spark):
    """Of a row repeated thousands of times about as many are drawn as are wanted, however languages' sizes are joined."""
    docs = spark.createDataFrame([(1, "the same text", "en")] * 5000 + [(i, f"text {i}", "de") for i in range(50)], "doc_id bigint, text string, lang string")
    for many in (10, 0):
        got = Counter(r.lang for r in language.sample(docs, 500, many).collect())
        assert 500 <= got["en"] <= 720 and got["de"] == 50


def test_language_names_that_are_taken(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("source", "score")
    out = language.identify(docs, language.fit(docs))
    assert out.columns == [*docs.columns, "lang_pred", "_score", "rejected"] and out.count() == docs.count()


def test_language_rejects_what_is_far(spark):
    docs = spark.createDataFrame([(i, prose(i, 60), "aa", "s", 1) for i in range(60)] + [(100 + i, prose(i, 60).translate(str.maketrans("aeiou", "wxyzq")), "bb", "s", 1) for i in range(60)], SCHEMA)
    model = language.fit(docs)
    new = spark.createDataFrame([(1, prose(7, 60)), (2, "Ωμέγα και άλλα γράμματα " * 5)], "doc_id long, text string")
    assert [(r.lang_pred == "aa", r.rejected) for r in language.identify(new, model).orderBy("doc_id").collect()][0] == (True, False)
    assert language.identify(new, model).where("doc_id = 2").first().rejected


def entropy(rows, targets, new=()):
    """Plain cross entropies of the same models, by dictionaries: of rows without their own counts, then of new texts with all counts."""
    words = lambda text: re.findall(r"[^\W_]+", (text or "").replace("İ", "i").lower())
    pairs = lambda ws: list(zip(["", *ws], ws))
    model = {kind: (Counter(), Counter(), Counter()) for kind in (True, False)}
    for (_, text), target in zip(rows, targets):
        ws = words(text)
        for counter, values in zip(model[target], (ws, [*ws, *[""] * bool(ws)], pairs(ws))):
            counter.update(values)
    size = len(set(model[True][0]) | set(model[False][0])) + 1
    total = {kind: sum(model[kind][0].values()) for kind in model}
    fewer = min(total.values())
    out = []
    for (_, text), target in [*zip(rows, targets), *((("", x), None) for x in new)]:
        ws, means = words(text), []
        for kind in (True, False):
            k = fewer / total[kind] if fewer else 1.0
            seen = kind == target
            loss = 0.0
            for v, w in pairs(ws):
                c = [k * (c[x] - seen * own.count(x)) for c, x, own in zip(model[kind], (w, v, (v, w)), (ws, ["", *ws], pairs(ws)))]
                p = (c[0] + lm_score.FLOOR) / (k * total[kind] + lm_score.FLOOR * size)
                loss -= math.log2((c[2] + lm_score.WEIGHT * p) / (c[1] + lm_score.WEIGHT))
            means.append(loss / len(ws) if ws else None)
        out.append((len(ws), *means, means[0] - means[1] if ws else None))
    return out


def close(got, want):
    key = lambda x: (str(x[0]), x[1], round(x[2] or 0, 6), round(x[3] or 0, 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and (g[2:] == w[2:] if w[1] == 0 else g[2:] == pytest.approx(w[2:], abs=1e-9)), (g, w)


@pytest.mark.parametrize("block", [300, 16 << 20])
def test_cross_entropy_equals_plain_models(spark, odd_rows, monkeypatch, block):
    """Documents without their own counts, in blocks of any size; ids of targets joined either way; new texts with all counts."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    rows = [(r[0], r[1]) for r in odd_rows if r[0] not in (6, 7, 12)] + [(20, "İİ İstanbul straße 😀 x"), (20, "İİ İstanbul straße 😀 x"), (21, "to be or not to")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, block string").repartition(3)
    targets = spark.createDataFrame([(1,), (14,), (14,), (None,), (555,), (20,)], "doc_id bigint")
    new = ["Ωμέγα tari zzz", "Ωμέγα tari zzz", "😀\x01", "", None, "one two one two"]
    want = entropy(rows, [r[0] in (1, 14, 20) for r in rows], new)
    blocks = lm_score.in_blocks(docs, targets)
    models = lm_score.fit(blocks)
    for own in (models, lm_score.fit_own(blocks)):
        assert (own.target, own.background, own.vocabulary) == (models.target, models.background, models.vocabulary)
        close(lm_score.score(blocks, own).collect(), [(r[0], *w) for r, w in zip(rows, want)])
    by_join = lm_score.with_target(docs, targets, 0)
    assert sorted((str(r.doc_id), r.side) for r in by_join.collect()) == sorted((str(r[0]), int(r[0] in (1, 14, 20))) for r in rows)
    fresh = lm_score.in_blocks(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"))
    close(lm_score.score(fresh, models).collect(), [(i, *w) for i, w in enumerate(want[len(rows) :])])


def test_cross_entropy_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint")
    assert lm_score.compare(no_docs, none).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.where("length(text) < 5000 or text is null").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    close(lm_score.compare(docs, none).collect(), [(r[0], *w) for r, w in zip(rows, entropy(rows, [False] * len(rows)))])


def test_target_documents_score_lower(spark):
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    rows = QUERIES["op8_lm_score"](spark, DATA).collect()
    mean = lambda ids: np.mean([r.score for r in rows if r.doc_id in ids and r.score is not None])
    assert len(rows) == 1000 and mean(good) < mean(bad)


def test_repeated_documents_are_set_apart(spark):
    """A text that occurs once more is known to its model; the same text alone is not."""
    rows = [(i, prose(i, 80, 3000)) for i in range(40)]
    rows.append((100, rows[0][1]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.ce_background for r in lm_score.compare(docs, spark.createDataFrame([(30 + i,) for i in range(10)], "doc_id bigint")).collect()}
    assert max(got[0], got[100]) < min(v for k, v in got.items() if k not in (0, 100)) - 1


def test_languages_do_not_hang_on_partitions(spark, monkeypatch):
    """The same rows in other partitions give the same model, where the sample leaves most rows out; repeated rows are drawn each by itself."""
    monkeypatch.setattr(language, "SAMPLE", 12)
    rows = [(k, prose(k, 25), f"l{k % 3}") for k in range(150)] + [(7, "again and again", "l1")] * 60 + [(None, prose(900, 20), "l2"), (4, None, "l0"), (5, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    answers = []
    for parts in (1, 7):
        dealt = docs.repartition(parts, "text") if parts > 1 else docs.coalesce(1)
        out = language.identify(docs.select("doc_id", "text"), language.fit(dealt))
        answers.append(sorted(map(str, map(tuple, out.collect()))))
        drawn = [r.text for r in language.sample(dealt.where("lang is not null and text is not null"), 12).collect()]
        answers[-1].append(sorted(drawn))
        assert 3 <= drawn.count("again and again") <= 12 and len(drawn) < 70
    assert answers[0] == answers[1]
