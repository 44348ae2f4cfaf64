"""The engine's relations, built from the driver's tables, and generic sources and sinks.

Each adapter is one projection (or one join) that Catalyst prunes and pushes filters through; nothing is cached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFER_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, region, score, lat, lng``: suppliers at made-up places."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.col("s_nationkey").alias("region"), F.col("s_acctbal").alias("score"),
        (52 + ((k * 7919) % 1000) / 5000).alias("lat"), (21 + ((k * 104729) % 1000) / 5000).alias("lng"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced offers of entities: line items with their part's name, brand and category."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    line = table(spark, sf_dir, "lineitem")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        *OFFER_KEY,
        F.col("l_suppkey").alias("entity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"),
        F.col("l_quantity").cast("int").alias("minutes"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        (F.col("l_linenumber") == 7).alias("package"), (F.col("l_discount") >= 0.09).alias("promo"),
        F.col("l_shipdate").alias("ts"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``offers`` has of line items alone, for queries that deal these out before they meet their parts."""
    return table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("entity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), F.col("l_quantity").cast("int").alias("minutes"), F.col("l_shipdate").alias("ts"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", (F.col("vec_id") % 50).alias("entity")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# --- sources ----------------------------------------------------------------------------------------------


def json_files(spark: SparkSession, path: str, schema: T.StructType, ledger: DataFrame | None = None) -> DataFrame:
    """One JSON document a file, with ``content_hash`` and ``path``; files whose hash the ledger has are left out."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(
        F.sha2("value", 256).alias("content_hash"), F.input_file_name().alias("path"), "value"
    )
    if ledger is not None:
        raw = raw.join(ledger.select("content_hash"), "content_hash", "left_anti")
    return raw.withColumn("doc", F.from_json("value", schema)).select("content_hash", "path", "doc.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def csv_seed(spark: SparkSession, existing: str, user: str, schema: T.StructType, key: str, canonical: Column) -> DataFrame:
    """Union of two CSV files; of one canonical name the user's row stays."""
    from marketloom.operators.relational import union_first_wins

    read = lambda p: spark.read.csv(p, header=True, schema=schema).withColumn("_key", canonical)
    return union_first_wins([read(user), read(existing)], ["_key"], [F.col(key)]).drop("_key")


# --- sinks ------------------------------------------------------------------------------------------------


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def insert_ignore(df: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key the table lacks; the first row of a key in ``df`` counts."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(key)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    append(fresh, path)


def upsert(df: DataFrame, path: str, key: list[str], order: str) -> str:
    """Last write wins: a new version of the table beside the old one, whose path is returned.

    Parquet has no MERGE; writing a version and switching to it leaves readers whole at any time.
    """
    from marketloom.operators.relational import latest_per_key

    spark = df.sparkSession
    rows = spark.read.parquet(path).unionByName(df) if exists(spark, path) else df
    base, _, version = path.rpartition("/v")
    out = f"{base}/v{int(version) + 1}" if base and version.isdigit() else f"{path}/v1"
    latest_per_key(rows, key, [F.desc(order)]).write.parquet(out)
    return out


def replace_children(df: DataFrame, path: str, parent: str) -> None:
    """Rewrite the partitions of the parents in ``df`` and leave others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# --- filter documents -------------------------------------------------------------------------------------

_TESTS = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(v), "ilike": lambda c, v: c.ilike(v),
    "like": lambda c, v: c.like(v), "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def compile_filter(doc: dict, columns: set[str], depth: int = 10) -> Column:
    """A nested filter document ``{"and": [...]}, {"or": [...]}, {"not": ...}, {"column", "op", "value"}`` as a column.

    Only the given columns may be named, and nesting is bounded; anything else is an error.
    """
    if depth < 0:
        raise ValueError("the filter is nested too deeply")
    if "and" in doc or "or" in doc:
        key = "and" if "and" in doc else "or"
        parts = [compile_filter(x, columns, depth - 1) for x in doc[key]]
        out = F.lit(key == "and")
        for p in parts:
            out = (out & p) if key == "and" else (out | p)
        return out
    if "not" in doc:
        return ~compile_filter(doc["not"], columns, depth - 1)
    if doc.get("column") not in columns:
        raise ValueError(f"column {doc.get('column')!r} may not be filtered")
    if doc.get("op") not in _TESTS:
        raise ValueError(f"unknown test {doc.get('op')!r}")
    return _TESTS[doc["op"]](F.col(doc["column"]), doc.get("value"))
