"""Corpus pipeline: language ID, SimHash near-dedup, substring dedup, benchmark decontamination, source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relscope.llm.common import BATCH_BYTES, dropped, in_small_batches, read, saved
from relscope.llm.decontaminate import clean
from relscope.llm.language_id import known_language
from relscope.llm.mixing import mixed
from relscope.llm.simhash import keep_first
from relscope.llm.substring_dedup import repeated_passages, without_passages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    in_small_batches(spark, BATCH_BYTES)
    return known_language(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    in_small_batches(spark, BATCH_BYTES)
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go."""
    in_small_batches(spark, BATCH_BYTES)
    return without_passages(docs, repeated_passages(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixed(docs)


STAGES = [
    ("language", language),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Fingerprints and trained models can't be said in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written in the shared folder and read again by the next."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = saved(stage(spark, docs, sf_dir), name)
        if before:
            dropped(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    dropped(spark, before)  # the mix is a table of its own
    return out
