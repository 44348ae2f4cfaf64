"""A ledger of nested documents by key: the newest version whole, older ones as patches that lead back to them.

A commit takes a batch of documents. Unchanged ones only move counters of their key's head; a changed one becomes the new head,
and the old head is kept as the operations that turn the new document into it, or whole where a checkpoint is due.
Commits are idempotent by batch: each writes the rows it changed into a folder of its own and reads only those of earlier
batches, so a killed and repeated batch gives the same ledger.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.custom import patched
from marketloom.operators.decisions import canonical_json
from marketloom.operators.relational import top_k

SCHEMA = (
    "key string, version bigint, content_hash string, document string, ops string, first_seen timestamp, last_seen timestamp, n_seen bigint, batch bigint"
)


# --- patches ----------------------------------------------------------------------------------------------


def same(a: object, b: object) -> bool:
    """Equal as JSON: ``true`` is not 1, and 1.0 is not 1."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def pointer(at: str, part: str) -> str:
    return f"{at}/{part.replace('~', '~0').replace('/', '~1')}"


def patch(old: object, new: object, at: str = "") -> list[dict]:
    """Operations (RFC 6902: add, remove, replace) that turn ``old`` into ``new``.

    Objects are compared field by field. Of arrays, what both begin and end with stays; between, elements are compared in
    pairs, and what one array has more is removed from its end or added there.
    """
    if same(old, new):
        return []
    if isinstance(old, dict) and isinstance(new, dict):
        gone = [{"op": "remove", "path": pointer(at, k)} for k in old if k not in new]
        kept = [op for k, v in old.items() if k in new for op in patch(v, new[k], pointer(at, k))]
        return gone + kept + [{"op": "add", "path": pointer(at, k), "value": v} for k, v in new.items() if k not in old]
    if isinstance(old, list) and isinstance(new, list):
        head, most = 0, min(len(old), len(new))
        while head < most and same(old[head], new[head]):
            head += 1
        tail = 0
        while tail < most - head and same(old[-1 - tail], new[-1 - tail]):
            tail += 1
        a, b = len(old) - tail, len(new) - tail
        both = min(a, b)
        ops = [op for i in range(head, both) for op in patch(old[i], new[i], f"{at}/{i}")]
        ops += [{"op": "remove", "path": f"{at}/{i}"} for i in reversed(range(both, a))]
        return ops + [{"op": "add", "path": f"{at}/{i}", "value": new[i]} for i in range(both, b)]
    return [{"op": "replace", "path": at, "value": new}]


def compact(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def json_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The patch from one document to another as JSON; null where either is null or no JSON."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        try:
            return compact(patch(json.loads(a), json.loads(b)))
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)], dtype=object)


# --- the ledger -------------------------------------------------------------------------------------------


def batches(spark: SparkSession, path: str) -> list[int]:
    """Batches whose write was completed, by their folders' marks."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The ledger: of each (key, version) the row of the newest completed batch, of those below ``before`` if it is given."""
    done = [b for b in batches(spark, path) if before is None or b < before]
    if not done:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*[f"{path}/batch={b}" for b in done])
    return top_k(rows, ["key", "version"], [F.desc("batch")], 1)


def heads(ledger: DataFrame) -> DataFrame:
    return top_k(ledger, ["key"], [F.desc("version")], 1)


def commit(docs: DataFrame, path: str, batch: int, volatile: list[str], every: int = 30) -> None:
    """Commit a batch of ``key, ts, document`` (JSON text) and, if there, ``ready``.

    Documents are made canonical without the ``volatile`` fields. Rows of a null key or without JSON, and rows that are not
    ``ready`` (children incomplete), are left out: their key's head stays. Rows older than their head's last sight are late: they
    count as seen, but change nothing. Of equal times the smaller hash comes first. ``every``-th versions stay whole.
    Only keys of the batch are read and written; all rows of a key pass one window, so a batch is to hold bounded
    numbers of sights a key. To be used as ``foreachBatch(lambda df, n: commit(df, path, n, ...))``.
    """
    spark = docs.sparkSession
    rows = docs.filter("ready") if "ready" in docs.columns else docs
    rows = rows.select("key", "ts", canonical_json(volatile)(F.col("document")).alias("document")).filter("key IS NOT NULL AND ts IS NOT NULL AND document IS NOT NULL")
    seen = rows.withColumn("content_hash", F.sha2("document", 256))
    # By the keys of all rows, as documents are costly to read; keys that prove to have none drop out below.
    head = heads(read(spark, path, batch).join(docs.select("key").distinct(), "key", "left_semi"))
    known = head.select("key", F.col("last_seen").alias("head_seen"), F.col("content_hash").alias("head_hash"))
    seen = seen.join(known, "key", "left").withColumn("late", F.coalesce(F.col("ts") < F.col("head_seen"), F.lit(False)))
    # A late row counts as one more sight of the head.
    seen = seen.withColumns({c: F.when(F.col("late"), F.col(f"head_{h}")).otherwise(F.col(c)) for c, h in (("ts", "seen"), ("content_hash", "hash"))})
    before = head.select("key", "content_hash", "document", F.lit(0).alias("now"), F.col("last_seen").alias("ts"), "first_seen", "n_seen", "version")
    fresh = seen.select("key", "content_hash", F.when(~F.col("late"), F.col("document")).alias("document"), F.lit(1).alias("now"), "ts")
    order = Window.partitionBy("key").orderBy("now", "ts", "content_hash")
    both = before.unionByName(fresh, allowMissingColumns=True)
    both = both.withColumn("_any", F.max("now").over(Window.partitionBy("key"))).filter("_any = 1").drop("_any")
    new = both.withColumn("_new", (~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(order))).cast("int"))
    new = new.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = new.groupBy("key", "run", "content_hash").agg(
        F.max("document").alias("document"), F.coalesce(F.min("first_seen"), F.min("ts")).alias("first_seen"), F.max("ts").alias("last_seen"),
        F.sum(F.coalesce("n_seen", F.lit(1))).alias("n_seen"), F.max("version").alias("_head"),
    )
    by_run = Window.partitionBy("key").orderBy("run")
    first = F.coalesce(F.max("_head").over(Window.partitionBy("key")), F.lit(1))
    numbered = runs.withColumns({"version": first + F.col("run") - 1, "_next": F.lead("document").over(by_run)})
    delta = F.col("_next").isNotNull() & (F.col("version") % every != 0)
    ops = json_diff(F.when(delta, F.col("_next")), F.when(delta, F.col("document")))
    out = numbered.withColumn("ops", ops).withColumn("document", F.when(~delta, F.col("document")))
    columns = ["key", "version", "content_hash", "document", "ops", "first_seen", "last_seen", "n_seen", F.lit(batch).cast("long").alias("batch")]
    out.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def folded(chain: list[tuple[str | None, str | None]]) -> list[str | None]:
    """Documents of a chain of ``(document, ops)``, from its whole document back."""
    now, out = None, []
    for document, ops in chain:
        try:
            now = json.loads(document) if document is not None else None if now is None else patched(now, json.loads(ops), copy=False)
        except (LookupError, TypeError, ValueError):
            now = None
        out.append(None if now is None else compact(now))
    return out


def versions(ledger: DataFrame) -> DataFrame:
    """``key, version, content_hash, document`` of all versions: each chain is folded from its whole document back.

    A chain ends at the next whole document, so at most as many rows as lie between two checkpoints meet in one array. Python gets
    batches of many chains. A chain whose patches do not lead anywhere, or that has no whole document, gives null documents from
    there on.
    """
    whole = F.when(F.col("document").isNotNull(), F.col("version"))
    ahead = Window.partitionBy("key").orderBy("version").rowsBetween(0, Window.unboundedFollowing)
    chained = ledger.select("key", "version", "content_hash", "document", "ops").withColumn("base", F.min(whole).over(ahead))
    row = F.struct((-F.col("version")).alias("back"), "content_hash", "document", "ops")
    chains = chained.groupBy("key", "base").agg(F.array_sort(F.collect_list(row)).alias("chain"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            sizes, flat = pc.list_value_length(rows).to_numpy(), rows.flatten()
            texts = list(zip(flat.field("document").to_pylist(), flat.field("ops").to_pylist(), strict=True))
            ends = np.cumsum(sizes)
            documents = [x for start, end in zip(ends - sizes, ends, strict=True) for x in folded(texts[start:end])]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            columns = [keys, pc.negate(flat.field("back")), flat.field("content_hash"), pa.array(documents, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "version", "content_hash", "document"])

    return chains.select("key", "chain").mapInArrow(fold, "key string, version bigint, content_hash string, document string")
