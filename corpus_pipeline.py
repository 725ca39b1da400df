"""From documents to token ids: five stages, each a whole pass over what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, jaccard, pii, toxicity
from lectern.llm.batches import crc_mod, fresh_name, write
from lectern.sources.shared import fresh_path, remove, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below 0.5; learned from labels that are not held out.

    Null and empty texts are scored like any other; rows with null or repeated doc_ids and repeated rows are judged each by
    itself, equal texts alike; with no label, or labels of one kind, all get that kind's score (none: 0, all stay); an empty table
    gives none. Columns come back as they were, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 5) != 0)
    name = fresh_name(docs, "toxicity")
    return toxicity.score(docs, toxicity.fit(docs, labels), name).where(F.col(name) < 0.5).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the document with the lowest doc_id; at a tie the lowest text hash; a null doc_id only if no other has one.

    Null and empty texts have no duplicates, but rows equal in doc_id and text count as one. An empty table gives none.
    Columns come back as they were, whatever their names.
    """
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; null and empty items match nothing; repeated rows are judged each by itself, alike; an
    empty table gives none, with an empty benchmark all stay. Columns come back as they were, whatever their names.
    """
    name = fresh_name(docs, "leaks")
    return decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name, exact=False).where(F.size(name) == 0).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    A null text stays null, and its n_chars with it; an empty one stays empty; repeated rows stay and are masked alike; an empty
    table gives none. Other columns come back as they were, whatever their names.
    """
    out = pii.redact(docs)
    return out.select(*[F.length("text").cast(f.dataType).alias(f.name) if f.name == "n_chars" else F.col(f.name) for f in docs.schema.fields])


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to.

    Null reads as empty: no token, digests of the empty text. Each row gives one, repeated ones too; an empty table gives none.
    Other columns are left out.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_and_decode(docs.select("doc_id", "text"), path, digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("bpe", to_tokens),
]

#: Boosted trees and the tokenizer's merges are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written before the next reads it; its own tables go then, and so does what it read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark, name):
            out = stage(spark, docs, sf_dir)
            write(out, path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
