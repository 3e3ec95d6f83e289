"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weblake.llm import mixing, packing, pii, simhash, toxicity as weak_supervision
from weblake.llm.common import boxed, read_table, unboxed, with_length
from weblake.session import Work


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not judged toxic.

    Null and empty texts, which no voter marks, stay; repeated rows are judged each by itself; a null
    doc_id has no label and stays or goes by its text. Columns come through whatever their names; an empty table stays empty.
    """
    judged = weak_supervision.toxicity(boxed(docs), read_table(spark, sf_dir, "labels"))
    return unboxed(judged.filter("predicted = 0"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest by doc_id, of each group of op1: four-word shingles, at most 4 differing bits.

    Null and empty texts are one group; repeated rows count as copies; rows with a null doc_id all stay.
    Columns come through whatever their names; an empty table stays empty.
    """
    return simhash.keep_one(docs, words=4, max_bits=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars as the texts now have it.

    Null texts stay null; repeated rows and null doc_ids are treated like any other; an empty table stays empty.
    """
    return with_length(unboxed(pii.redact(pii.find(boxed(docs))), docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; documents of which it takes none go.

    Null and empty texts hold no word and go; a null source is a source of its own; repeated rows and null
    doc_ids are documents like any other. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences.

    A null text is an empty one, whose piece is the end id alone; repeated rows and null doc_ids are packed
    each by itself. Only doc_id and text are read; an empty table has no pieces.
    """
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data),
          ("mix_sources", mix_sources), ("pack", pack)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py compares each with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Earlier stages' tables go as soon as the next one is written."""
    work, docs = Work(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.table(name, stage(spark, docs, sf_dir))
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
