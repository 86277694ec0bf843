"""A training corpus from raw documents: toxic ones out, unknown languages out, one of each group of near-duplicates,
repeated passages out, and what is left packed into sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but the last return
the columns of the documents. A null text is not toxic, has no language, and so goes in the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pillflow.llm import langid, near, packing, suffixes, toxicity
from pillflow.llm.common import crc32_of, read, small_batches, stored, unused
from pillflow.llm.queries import REPEATED_BYTES, SEQUENCE_TOKENS, TOXIC_FROM


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``; labels of held-out documents are not learned from."""
    small_batches(spark)
    labels = read(spark, sf_dir, "labels").where(F.pmod(crc32_of("doc_id"), F.lit(4)) != 2)
    model = toxicity.learn(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    (score,) = unused(docs.columns, "_toxicity")
    return toxicity.score(docs, model, score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; without any language to learn from, all stay."""
    small_batches(spark)
    held_out = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(5)) == 0, F.lit(True))
    model = langid.learn(docs.where(~held_out).select("text", "lang"))
    if not model.languages:
        return docs
    language, share = unused(docs.columns, "_language", "_share")
    return langid.identify(docs, model, (language, share)).where(F.col(language) != "und").drop(language, share)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the lowest number."""
    small_batches(spark)
    return near.keep_one_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur anywhere else as well."""
    small_batches(spark)
    return suffixes.strip_repeats(docs, REPEATED_BYTES)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    small_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.cut_documents(docs, path, end_id=1, capacity=SEQUENCE_TOKENS), SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

#: Label model, similarity search and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
