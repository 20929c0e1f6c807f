"""Corpus preparation as a chain of stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from histria.llm import decontam, jaccard, langid, linededup, packing
from histria.llm.common import at_home, drop_tables, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or without a clear language go."""
    return langid.stage(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line (or near copy of it) stays at its first place only; documents of which nothing is left go."""
    return linededup.stage(spark, docs, sf_dir)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard.stage(spark, docs, sf_dir)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that a benchmark's passages make up by a twentieth or more."""
    return decontam.stage(spark, docs, sf_dir)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096: one row a piece."""
    return packing.stage(spark, docs, sf_dir)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate), ("pack", pack)]
STAGES = [(name, at_home(f)) for name, f in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    base = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        if last is not None:
            drop_tables(last)  # what the stage read
        docs = last = spark.read.parquet(f"{base}/{k}-{name}")
    return docs


#: A conditional random field and a packing plan have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None
