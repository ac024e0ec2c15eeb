"""The training-data pipeline over documents: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import fm_index, importance, lines, mixing, simhash
from labelloom.llm.common import discard, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    return importance.keep_sampled(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near lines stays; documents stay, with what is left of them."""
    return lines.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.one_per_group(docs, shingle=3, bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    return fm_index.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row per document and epoch taken."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing_stage),
]

#: Learned weights, MinHash components and XXH64 fingerprints cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stored and read back before the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if at == len(STAGES) - 1:
            return kept
        kept = stored(kept, "pipeline")
        if at:
            discard(docs)
        docs = kept
