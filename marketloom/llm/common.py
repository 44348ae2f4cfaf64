"""Shared pieces of the training-data operators: inputs, staged tables and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular-expression class.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters, for trim functions.
SPACE_CHARS = " \t\n\x0b\x0c\r"

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only a single-JVM session (``local[n]``) may leave it
    unset; it then gets a temporary folder. On a cluster a missing setting is an error, as a machine-local
    folder would lose data there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="marketloom-")
    return _own_dir[app]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get Arrow batches of at most 8 MB from jobs that are run inside, however large a partition is."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "8m")
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


class Scratch:
    """Staged tables in the shared folder: they cut lineage and outlive lost executors.

    Results are read from them later, so they stay until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        """Write ``df`` once and return what was written. Python workers get small Arrow batches meanwhile."""
        path = self.path(name)
        with small_batches(self.spark):
            df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null or blank text gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of words of a text, without building them."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(SPACE)) + 1).cast("long")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Rows agree in all keys, null with null; the right ones are named ``_drop_<key>``."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_drop_{k}"])
    return on


def without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` less the rows whose keys are in ``dropped`` (its first columns, in order; null equals null).

    A sort-merge join at every size, as dropped keys grow with the data: rows with their texts cross one shuffle.
    """
    named = Scratch(docs.sparkSession, "dropped").save(dropped.toDF(*[f"_drop_{k}" for k in keys]).distinct(), "keys")
    return docs.join(named.hint("merge"), same(docs, named, keys), "left_anti")


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells each row from all others.

    That is ``doc_id`` where no id is null or repeated. Else the rows are staged and get ``_row``: 1, 2, ... in the
    order of doc_id (null last), text digest and source, so that only rows equal in all three depend on partitions.
    The numbers meet the rows by a sort-merge join on a unique key.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    scratch = Scratch(docs.sparkSession, "rows")
    rows = scratch.save(docs.withColumn("_at", F.monotonically_increasing_id()), "rows")
    source = ["source"] if "source" in docs.columns else []
    order = rows.select("doc_id", F.sha2("text", 256).alias("_digest"), *source, "_at")
    order = order.orderBy(F.col("doc_id").asc_nulls_last(), "_digest", *source, "_at")
    # Places within the sorted partitions, then the rows of all partitions before.
    placed = scratch.save(order.select("_at", F.monotonically_increasing_id().alias("_place")), "placed")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    numbers = placed.join(F.broadcast(before), "_part").select(
        "_at", (F.col("_before") + F.col("_place") - F.shiftleft("_part", 33) + 1).alias("_row")
    )
    numbers = scratch.save(numbers, "numbers")
    return rows.join(numbers.hint("merge"), "_at").drop("_at"), "_row"
