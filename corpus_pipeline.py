"""Training-corpus pipeline: language ID, exact dedup, near dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of `documents`.

Defined results: an empty table gives no rows; a null or empty text has no language that could be told, so its row
goes in the first stage, as does a row without letters; of repeated rows one stays; a null id takes part
like any other until near duplicates, where it is linked with nothing; columns beside id and text
are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlattice.llm import exact_dedup, langid, neardup, packing
from memlattice.llm.shared import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told."""
    return langid.drop_unidentified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of equal texts, that of the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component (five-word shingles, 0.8)."""
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, capacity=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("best_fit_packing", packed_sequences),
]

#: Trained centroids, MinHash confirmation and tokenisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's table goes as soon as the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        step = Scratch(spark)
        docs = step.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.clear()
        before = step
    return STAGES[-1][1](spark, docs, sf_dir)
