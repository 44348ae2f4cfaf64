"""Exact similarity of vectors within a key, block by block: rows of a key are dealt to blocks of a bounded size, pairs of
blocks meet by the key, and a task multiplies two matrices and keeps a few numbers of each row.

All vectors of a key are compared, as the results are exact; the work spreads over block pairs, not over keys, and one
pair of rows costs a few nanoseconds. Keys that hold more than some hundred thousand vectors want a narrower key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.relational import top_k


def blocked(df: DataFrame, key: str, side: str, size: int, apart: str) -> DataFrame:
    """``key`` and arrays of about ``size`` rows ``(id, vector, apart)`` of it; rows without a vector are left out."""
    rows = df.filter("vector IS NOT NULL").select(key, F.col("id").cast("long").alias("id"), F.col(apart).cast("long").alias("_apart"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = rows.groupBy(key).agg(F.ceil(F.count("*") / size).alias("_blocks"))
    placed = rows.join(blocks, key).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    row = F.collect_list(F.struct("id", "_apart", "vector"))
    return placed.groupBy(key, "_block").agg(row.alias("r")).select(
        key, F.col("r.id").alias(f"{side}_ids"), F.col("r._apart").alias(f"{side}_apart"), F.flatten("r.vector").alias(f"{side}_values")
    )


def nearest_within(subjects: DataFrame, others: DataFrame, key: str, k: int, floor: float = -1.0, size: int = 512, apart: str = "id") -> DataFrame:
    """``subject_id, id, similarity`` (4 decimals): of each subject the k most similar other ids of its key from ``floor`` up,
    ties by id. Rows are ``id, vector, key``; pairs that agree in the number ``apart`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for row in range(batch.num_rows):
                a_ids, a_apart, a, b_ids, b_apart, b = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(6))
                a, b = a.reshape(len(a_ids), -1), b.reshape(len(b_ids), -1)
                a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
                order = np.argsort(b_ids, kind="stable")
                b_ids, b_apart, b = b_ids[order], b_apart[order], b[order]
                steps = np.rint(a @ b.T * 10_000).astype(np.int64)
                rank = steps * len(b_ids) - np.arange(len(b_ids))  # higher is nearer; of equals the smaller id
                rank[a_apart[:, None] == b_apart[None, :]] = np.iinfo(np.int64).min
                n = min(k, len(b_ids))
                at = np.argpartition(-rank.astype(float), n - 1, axis=1)[:, :n] if n < len(b_ids) else np.tile(np.arange(len(b_ids)), (len(a_ids), 1))
                found = np.take_along_axis(steps, at, 1)
                fits = (np.take_along_axis(rank, at, 1) > np.iinfo(np.int64).min) & (found >= np.ceil(floor * 10_000 - 1e-6))
                out[0].append(np.repeat(a_ids, at.shape[1])[fits.ravel()])
                out[1].append(b_ids[at].ravel()[fits.ravel()])
                out[2].append(found.ravel()[fits.ravel()] / 10_000)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["subject_id", "id", "similarity"])

    pairs = blocked(subjects, key, "a", size, apart).join(blocked(others, key, "b", size, apart), key)
    tasks = int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select("a_ids", "a_apart", "a_values", "b_ids", "b_apart", "b_values").repartition(tasks)
    near = pairs.mapInArrow(run, "subject_id long, id long, similarity double")
    return top_k(near, ["subject_id"], [F.desc("similarity"), F.col("id")], k)
