"""Exact dedup against a persistent digest index.

The index is a table of ``(digest, keep_id)`` bucketed and sorted by digest. A batch of documents is reduced
to one row per digest before anything is joined, the rows that the index lacks are found by a sort-merge
anti-join and appended, and every document then learns which document stands for its text. Only DataFrame
functions run; the text itself never crosses a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import SPACE, Scratch, table, without


def normalised(text: Column) -> Column:
    """A text with every run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class DigestIndex:
    """Digests seen so far, on disk under ``path``, in ``buckets`` buckets sorted by digest.

    The table outlives the session: opening the same path again finds the digests of earlier batches. Adding
    a batch twice changes nothing, as its digests are then in the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + table_name(path)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> None:
        """Append the digests of ``groups (digest, first_id)`` that the index lacks."""
        fresh = groups.hint("merge").join(self.read().hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", F.col("first_id").alias("keep_id"))
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .option("path", self.path)
            .mode("append")
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the table's name in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def table_name(path: str) -> str:
    """A table name of its own for each path."""
    return hashlib.sha256(path.encode()).hexdigest()[:32]


def dedup(docs: DataFrame, index_path: str | None = None, buckets: int = 64) -> DataFrame:
    """Each document with the document that stands for its text.

    Returns ``doc_id, keep_id, group_size, kept, digest``: ``keep_id`` is the smallest doc_id of the first
    batch that held the text, ``group_size`` counts this batch's documents with it, ``kept`` marks the one
    row that stays. Null texts count as empty, so they form one group with empty ones. Rows that repeat a
    doc_id with the same text are all marked as kept if it is the smallest; an empty table gives no rows.
    Other columns of ``docs`` are not read.

    A group may hold a third of all rows: groups are pre-aggregated, and the join back reads two staged
    tables, so that adaptive execution can split a hot digest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    digests = scratch.save(
        docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "digests"
    )
    groups = scratch.save(
        digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "groups"
    )
    index = DigestIndex(spark, index_path or scratch.path("index"), buckets)
    index.add(groups)
    verdicts = scratch.save(groups.join(index.read(), "digest").select("digest", "keep_id", "group_size"), "verdicts")
    index.close()
    return digests.join(verdicts, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def keep_first(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """The documents that stay, with their own columns; a repeated row of a kept document stays once."""
    verdicts = Scratch(docs.sparkSession, "exact-dedup").save(dedup(docs, index_path), "rows")
    rows = docs.withColumn("_digest", F.unhex(F.sha2(normalised(F.col("text")), 256)))
    kept = verdicts.filter("kept").select("doc_id", "digest")
    if kept.count() != kept.distinct().count():
        rows = rows.dropDuplicates(["doc_id", "_digest"])
    return without(rows, verdicts.filter("NOT kept").select("doc_id", "digest"), ["doc_id", "_digest"]).select(docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""
