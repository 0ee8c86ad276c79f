"""The corpus pipeline: each stage applies one operator to what the stage before it kept.

documents -> quality classifier -> near-duplicate removal -> removal of repeated passages -> packing. All stages but
the last return the columns of documents.

Every stage takes rows as they come: null and repeated ids, repeated rows, null, empty and very long texts, further columns
of any name. Empty tables give no rows. What becomes of each case is said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.common import read, shared_dir, small_batches
from matchloom.llm.compression import keep_good
from matchloom.llm.minhash import drop_duplicates
from matchloom.llm.packing import pack
from matchloom.llm.queries import vocabulary
from matchloom.llm.runindex import without_repeats

#: Similarity in percent of near duplicates, and bytes of a repeated passage (51 short words have more).
SIMILARITY, PASSAGE_BYTES = 80, 230


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject (score 0.3 at least).

    Each row is judged by its own text, so repeated rows stay or go together; null and empty texts get the score of no
    difference, and so do all where there are no labels of both kinds.
    """
    small_batches(spark)
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id (null ids come last).

    Texts without words are copies of nothing and stay. Rows that repeat an id and a text stay together; rows that repeat
    an id with other texts are judged each by its text; of rows without id that repeat a text one stays.
    """
    small_batches(spark)
    return drop_duplicates(docs, percent=SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once; n_chars is counted anew.

    No row goes: a text that is repeated as a whole is left empty, a null text stays null. Repeated rows repeat their text.
    """
    small_batches(spark)
    return without_repeats(docs, length=PASSAGE_BYTES)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    Null and empty texts are the end id alone. Null and repeated ids are kept, each row by itself.
    """
    small_batches(spark)
    return pack(docs, vocabulary=vocabulary("byte_bpe_50k.json"), end_id=2, keep_ids=False).drop("ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]
#: SQL has neither the dictionaries nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{path}/{name}")
    return docs
