"""The corpus pipeline: quality rules, exact and near deduplication, mixing, packing.

Every stage takes nulls in any column, empty and very long texts (always read
whole), ties, repeated rows, empty tables and extra columns of any names. All
but the last return the columns of their input with the values as given; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from pointloom.llm.common import stored


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.

    Null, empty and blank texts break no rule and stay, as do documents whose
    language has no certified cutoff. A feature equal to its cutoff breaks no
    rule; repeated rows share their fate.
    """
    return quality_rules.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays: the one with the smallest id.

    Null texts are nobody's copies and stay; empty texts are copies of each
    other. Null ids come last; of rows tied in text and id one stays.
    """
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id.

    Null texts, and texts without words, are in no group and stay. Null ids come
    last, ties are broken by content; of repeated rows one stays.
    """
    return near_dedup.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their targets.

    Null sources and languages are values of their own. Null and empty texts
    have no tokens; they go where their cell has weight 0. Repeated rows share
    their fate, as the draw depends on id (or text, without one).
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their bins: (doc_id, piece, tokens, shard, bin,
    bin_offset).

    Null and empty texts take no room and have no row; very long ones have
    several. Null ids are carried along, repeated rows are packed one by one,
    ties in the order are interchangeable. Extra columns are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Quality cutoffs, near-duplicate groups and packing are beyond SQL; tests hold
#: run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before wrote. What
    odd rows give is stated at the stages; without documents there are no bins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
