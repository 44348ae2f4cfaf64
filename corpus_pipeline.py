"""A corpus pipeline of five stages, each working on all that the one before it kept.

Quality rules drop documents, exact and near duplicates leave one document of each group, mixing repeats or
leaves out documents by source, and packing places what remains in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm.common import Scratch, table
from marketloom.llm.exact_dedup import keep_first
from marketloom.llm.mixing import mixed
from marketloom.llm.near_dedup import keep_one
from marketloom.llm.packing import pack
from marketloom.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their stratum's cutoffs. Each row goes by its own text; null and empty texts go,
    repeated rows stay or go together, other columns are kept as they are, an empty table gives no rows."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts after white space is normalised, the row of the smallest doc_id; of its repeated rows, one. Null texts
    are equal to empty ones; null ids come after all others. An empty table gives no rows."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts (five words, 0.8), the row of the smallest doc_id. Rows without words are in no
    component and stay; rows of a null or repeated doc_id count one by one. An empty table gives no rows."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (0 to 2 times), by the weights of its source; a null source is one of its own.
    Rows of a null or repeated doc_id are taken one by one. An empty table gives no rows."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens; a row that the mix repeats is packed as often. Null texts are their
    end id only, texts of any length are cut into pieces. An empty table gives no rows."""
    return pack(docs)[1]


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Sketches, risk-controlled cutoffs, random balancing and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
