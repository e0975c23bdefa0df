"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewarden.llm import langid, mixing, quality, simhash, spiece
from pagewarden.llm.common import discard, scratch, table
from pagewarden.llm.queries import labelled_domains


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the error-correcting codes can tell."""
    return langid.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior is good, and not toxic, given their text, source and language."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one_of_each(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, repeated as often as its fitted rate says."""
    return mixing.mixed(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of each whole text."""
    return spiece.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing_to_targets", mixing_to_targets),
    ("sentencepiece", sentencepiece),
]

#: Trained classifiers and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written below the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)  # the next stage reads only what this one wrote
        before = [docs]
    return docs
