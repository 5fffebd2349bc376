"""Cleaning and packing of a text corpus in five stages; each works on all that the one before kept.

1. quality: documents that the importance-resampling classifier rejects go.
2. lines: lines that repeat an earlier line go: equal ones, and from 16 characters on those one edit apart.
3. near_duplicates: one document of each SimHash group stays, that with the smallest id.
4. substrings: words in repeated passages of ``PASSAGE_WORDS`` words or more go.
5. packing: token pieces are packed into sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footpath.llm import importance, line_dedup, packing, simhash, substring_dedup
from footpath.llm.common import materialize, tokenizer_file

#: Words of a repeated passage.
PASSAGE_WORDS = 50

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts have no evidence against them and stay; repeated rows are judged
    alike; rows with a null id share one noise; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.classify(docs, labels).where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go.  A null text stays null, and rows with a null id stay as they are; rows that share an id are
    judged alike; a document all of whose lines go stays, with an empty text."""
    return _with_text(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays.  Null and empty texts are one group; rows with a null id stay; rows that
    share an id stay or go together."""
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated passages go.  A null text stays null; rows with a null id stay as they are; rows that share an id are documents
    of their own."""
    return _with_text(substring_dedup.without_repeats(docs, window=PASSAGE_WORDS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts and their places in sequences.  A null or empty text is one piece, its end; null ids and repeated rows
    have pieces of their own."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", pack),
]

#: SQL can't express the hashed models, fingerprints and the packing; the tests hold each stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
