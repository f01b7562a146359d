"""Corpus pipeline over documents: language ID, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes all rows that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import bpe, decontam, lang_id, line_dedup, shingle_join
from chronoweave.llm.common import table, written

#: SQL expresses neither the learned filters nor the fingerprints' windows; tests hold run() against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text has no letter or whose best language knows too few of its n-grams."""
    return lang_id.known(docs, lang_id.learn(lang_id.training(docs)))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs from the texts; all rows stay."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts linked by a five-word Jaccard of 0.8 or more."""
    return shingle_join.survivors(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, of each row."""
    return bpe.digests(docs, bpe.default_tokenizer())


STAGES = [
    ("language_id", language),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
