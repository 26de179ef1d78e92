"""A corpus pipeline: language ID, exact dedup, n-gram Jaccard dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet in the
cluster's shared folder and reads it again as the next stage's ``docs``.  All stages but the last return the columns
of ``docs``; the last returns what the mix takes of each document it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changelens.llm import decontaminate, exact_dedup, language_id, mixing, ngram_jaccard, work


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, fitted on this stage's own input, recognises."""
    return language_id.keep(docs, language_id.fit(language_id.learnable(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return ngram_jaccard.deduplicate(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a test item."""
    return decontaminate.remove(docs, work.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("decontaminate", leaks),
    ("mix_sources", mix),
]
#: Language models, alignments and random draws are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = work.read(spark, sf_dir, "documents"), work.mark(spark)
    for _, stage in STAGES:
        docs = work.stage(stage(spark, docs, sf_dir))
        work.only_latest(spark, since)  # what this stage and the one before have written is not needed any more
    return docs
