"""Corpus pipeline over ``documents``: language ID, line dedup, SimHash near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the
columns of ``documents`` (the last one: the packed pieces). :func:`run` writes each stage's result as
Parquet into the shared checkpoint folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.llm import langid, linededup, packing, pii, simhash
from textpairs.llm.common import cut, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the others go (no letters, or a margin too narrow to
    tell). A missing ``lang`` is set to it. Learned from the same rows as op2 learns from."""
    names = docs.columns
    model = langid.train(docs.where(~langid.held_out()))
    return (langid.predict(docs, model).where(~F.col("rejected"))
            .withColumn("lang", F.coalesce("lang", "lang_pred")).select(*names))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs deleted from ``text``; no document goes."""
    return linededup.dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest doc_id."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data in ``text`` masked; no document goes."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all tokenised pieces in sequences of at most 1024 tokens."""
    return packing.digest(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", pack),
]

# Compression sizes, fingerprints and token ids are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
