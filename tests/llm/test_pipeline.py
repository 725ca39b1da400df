import hashlib
from pathlib import Path
from urllib.parse import urlparse

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import decontaminate, toxicity
from lectern.llm.batches import crc_mod
from lectern.sources.shared import shared_folder

from .conftest import SCHEMA, prose
from .test_decontaminate import brute as leaks
from .test_jaccard import brute as classes
from .test_pii import brute as spans

DATA = "/root/testdata/sf0.001"


def masked(text):
    out, at = [], 0
    for kind, a, b in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "pii", "bpe"]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    stage = dict(corpus_pipeline.STAGES)

    out = stage["toxicity"](spark, docs, DATA)
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet").where(crc_mod("doc_id", 5) != 0))
    assert out.columns == columns
    assert set(rows(out)) == {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}

    before = rows(out)
    out = stage["ngram_jaccard_join"](spark, out, DATA)
    want = {c for _, c, _, _ in classes([(r.doc_id, r.text) for r in before.values()])}
    assert out.columns == columns and set(rows(out)) == want and all(r == before[k] for k, r in rows(out).items())

    before = rows(out)
    out = stage["decontamination"](spark, out, DATA)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = {r.doc_id for r in decontaminate.find_leaks(spark.createDataFrame(list(before.values()), docs.schema), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect() if r.leaks}
    assert all(leaks(before[d].text, items) for d in found)
    assert out.columns == columns and set(rows(out)) == set(before) - found

    before = rows(out)
    out = stage["pii"](spark, out, DATA)
    assert out.columns == columns
    for k, r in rows(out).items():
        if "IBAN" not in r.text:
            assert r.text == masked(before[k].text)
        assert r.n_chars == len(r.text)

    before = rows(out)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    last = rows(stage["bpe"](spark, out, DATA))
    assert set(last) == set(before)
    for k, r in last.items():
        ids = library.encode(before[k].text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    folder = Path(urlparse(shared_folder(spark)).path)
    known = set(folder.iterdir())
    assert sorted(map(str, rows(corpus_pipeline.run(spark, DATA)))) == sorted(map(str, last))
    # What the stages wrote on their way is gone, but for the last one's input; nothing else is.
    assert known < (now := set(folder.iterdir()))
    assert [p.name[:9] for p in now - known] == ["stage-pii"]


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), SCHEMA)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, prose(1, 30), "a", "b", "c", "d"), (2, None, "a", "b", "c", "d")], "doc_id bigint, text string, text_hash string, leaks string, pii_spans string, toxicity string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.count() == 2, name
