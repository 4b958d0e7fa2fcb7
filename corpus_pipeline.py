"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, whatever else they are and are named. The last returns packed pieces.

An empty table passes every stage as one. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixlake.durable import durable
from helixlake.llm import decontam, exact_dedup, langid, near_dedup, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified: null and empty texts, those without a letter and those whose margin is
    narrow go. Rows that repeat are judged each; ties between languages are narrow."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, the one with the largest id; a null id is smaller than any. Null equals the
    empty text. One of rows that repeat stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id. Texts without words, null ones among
    them, are no duplicates; rows that repeat exactly stay or go together, and exact dedup has left none."""
    return near_dedup.drop_near(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: no window of ten words of an item, nor a whole shorter item. Null and
    empty texts stay; null items and ones without words match nothing. Rows that repeat are judged each."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences. Null texts are empty ones: a piece of the separator alone. Rows that
    repeat are packed each."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("benchmark_decontamination", benchmark_free),
    ("best_fit_packing", pack),
]
#: Compression sizes, MinHash and BPE aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
