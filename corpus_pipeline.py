"""A training-data pipeline: each stage reads what its predecessor kept.

A stage is a function of (spark, docs, sf_dir).  All but the last return the columns of `documents`; the last returns
the packed pieces.  `run` writes each stage's rows as Parquet in the shared folder, reads them for the next one, and
removes them once that is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larchspan.llm import exact_dedup, mixing, packing, quality_cascade, simhash_gray
from larchspan.session import discard, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_cascade.keep(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup.keep_best(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints."""
    return simhash_gray.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight, in a global shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("mixing", mix_sources), ("packing", pack)]
#: SQL cannot express XXH64 fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the rows of the stage before are written on and needed no more
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
