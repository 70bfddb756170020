"""From raw documents to packed training bins: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import mixing, near_dups, packing, quality, repeats
from corpusloom.llm.common import table, written
from corpusloom.session import ship_package


PASSAGE_BYTES = 250  # strings cut where they repeat: 50 words with their spaces, five bytes each


def _documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines; documents that fail the base rule or lose too much text go."""
    ship_package(spark)
    return _documents(quality.clean(docs), docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    ship_package(spark)
    return near_dups.deduplicate(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings as long as 50 words that occur twice or more are cut out."""
    ship_package(spark)
    return _documents(repeats.cut_documents(docs, length=PASSAGE_BYTES), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a row a round, and one for the parts of the last round."""
    ship_package(spark)
    return _documents(mixing.mixed_documents(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and offset of every piece of every document."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # near duplicates, string cuts and packing are beyond SQL: tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
