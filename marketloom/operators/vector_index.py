"""A persistent inverted-file index of vectors, and nearest neighbours from it.

Coarse centroids are trained on a bounded sample; every vector lies in the list of its nearest centroid. A list has at most a
bounded number of rows: larger ones are divided. A search probes the lists that may hold a better neighbour first: what a list may hold
is bounded by its centroid and by how far its vectors lie from it. A query stops when that bound proves its k-th neighbour, so
results are exact; or after a number of lists, if it is told so. Queries go to the lists they probe, never to all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.blocks import nearest_within
from marketloom.operators.relational import bounded, top_k
from marketloom.operators.staging import staged

#: Similarities are compared by four decimals, so a bound must be lower by more than that to end a search.
STEP = 1e-4
#: Lists at most; their centroids are sent to all tasks.
MOST_LISTS = 16_384


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths, of length 1 each."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def sampled(vectors: DataFrame, n: int, sample: int) -> list:
    """The ``sample`` rows ``(id, vector)`` of the smallest hashed ids, of about ``n``.

    A limit alone would have each task send so many rows to the driver. Hashes are spread evenly, so a bound on them leaves a few
    more than are asked for in all; it grows until it leaves enough. Where ids repeat so often that it leaves many, the limit decides.
    """
    hashed = vectors.select("id", "vector", F.xxhash64("id").alias("_hash"))
    share = 1.1 * sample / max(n, 1)
    while share < 1:
        few = hashed.filter(F.col("_hash") < int(2**64 * share) - 2**63)
        left = few.count()
        if left > 3 * sample:
            break
        if left >= sample:
            return sorted(few.collect(), key=lambda r: (r["_hash"], r.id))[:sample]
        share *= 2
    return hashed.orderBy("_hash", "id").limit(sample).collect()


def train(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 8, n: int = 0) -> np.ndarray:
    """Centroids of at most ``sample`` vectors, those of the smallest hashed ids, by spherical k-means on the driver; ``n`` is the number
    of vectors where it is known."""
    few = sampled(vectors, n, sample)
    if not few:
        return np.zeros((0, 0))
    rows = unit(np.array([r.vector for r in few], float))
    centres = rows[np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        met = np.bincount(own, minlength=len(centres)) > 0
        centres[met] = unit(sums[met])
    return centres


def build(vectors: DataFrame, path: str, size: int = 512, most: int = 2048, sample: int = 20_000) -> None:
    """Write the index of ``(id, vector)`` rows under ``path``: ``rows`` (id, vector, list), sorted by list, and ``lists`` (list,
    n, reach, centroid), where ``reach`` is the least cosine of a row to the centroid.

    About one list for ``size`` rows, MOST_LISTS at most; a list of over ``most`` rows is divided by id, its parts keep the
    centroid. All rows are indexed; those without a vector, and zero vectors, are left out. Repeated ids stay repeated.
    """
    known = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    known = known.filter(F.exists("vector", lambda x: x != 0))
    n = known.count()
    centres = train(known, min(MOST_LISTS, max(1, -(-n // size))), sample, n=n)
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = matrix(batch.column(1)) @ held.value.T
            best = np.argmax(sims, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(sims[np.arange(len(best)), best])], ["id", "vector", "centre", "cos"])

    placed = staged(known.mapInArrow(assign, "id bigint, vector array<double>, centre bigint, cos double"), "assigned")
    parts = placed.groupBy("centre").agg(F.ceil(F.count("*") / most).alias("parts"))
    numbered = placed.join(parts, "centre").withColumn("list", F.concat_ws(".", "centre", F.pmod(F.xxhash64("id"), F.col("parts"))))
    numbered.select("id", "vector", "list").repartitionByRange("list").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/rows")
    lists = numbered.groupBy("list", "centre").agg(F.count("*").alias("n"), F.min("cos").alias("reach"))
    rows = [(r.list, r.n, r.reach, centres[r.centre].tolist()) for r in bounded(lists, 8 * MOST_LISTS).collect()]
    spark = vectors.sparkSession
    spark.createDataFrame(rows, "list string, n bigint, reach double, centroid array<double>").write.mode("overwrite").parquet(f"{path}/lists")


def may_hold(queries: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The greatest cosine that a query may have to a row of each list: that of the angle to the centroid less the list's own."""
    angle = np.arccos(np.clip(queries @ centres.T, -1, 1)) - np.arccos(np.clip(reach, -1, 1))
    return np.cos(np.maximum(angle, 0))


def search(spark: SparkSession, queries: DataFrame, path: str, k: int, floor: float = -1.0, first: int = 4, probes: int | None = None) -> DataFrame:
    """``subject_id, id, similarity``: for each query ``(id, vector)`` its k most similar other ids of the index from ``floor``
    up, ties by id.

    Exact unless ``probes`` limits the lists of a query. Lists are probed in the order of what they may hold: ``first`` of them, then twice as
    many in each round, for queries that are not yet proven. Rows of a query and of the lists that it probes meet by the
    list's name, in blocks of bounded size. Queries without a vector, or with a zero one, have no result.
    """
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # as many as were written within the bound of build
    names = np.array([r["list"] for r in lists], object)
    held = spark.sparkContext.broadcast((names, np.array([r.centroid for r in lists], float), np.array([r.reach for r in lists], float)))
    rows = spark.read.parquet(f"{path}/rows")
    own = queries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter(F.exists("vector", lambda x: x != 0))
    state = staged(own.withColumn("kth", F.lit(float(floor))), "queries")
    found, start, stop = None, 0, first
    most = min(len(lists), probes or len(lists))
    while start < most:
        stop = min(stop, most)

        def plan(batches: Iterator[pa.RecordBatch], start: int = start, stop: int = stop) -> Iterator[pa.RecordBatch]:
            names, centres, reach = held.value
            for batch in batches:
                at = 0
                while at < batch.num_rows:  # a few queries at a time: one has a number for every list
                    part = batch.slice(at, 256)
                    at += 256
                    bound = may_hold(matrix(part.column(1)), centres, reach)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
                    hit = np.take_along_axis(bound, order, 1) >= part.column(2).to_numpy()[:, None] - STEP
                    who = np.repeat(np.arange(part.num_rows), hit.sum(1))
                    taken = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(names[order[hit]].tolist(), pa.string())], ["id", "vector", "list"])

        probed = staged(state.mapInArrow(plan, "id bigint, vector array<double>, list string"), "probes")
        if probed.isEmpty():
            break
        near = nearest_within(probed, rows, "list", k, floor)
        found = staged(near if found is None else top_k(near.unionByName(found), ["subject_id"], [F.desc("similarity"), F.col("id")], k), "found")
        full = found.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"), F.min("similarity").alias("s")).filter(F.col("n") >= k)
        # A query goes on only if its last round probed something: bounds fall from list to list.
        going = state.join(probed.select("id").distinct(), "id", "left_semi").join(full, "id", "left")
        state = staged(going.select("id", "vector", F.greatest("kth", F.coalesce("s", "kth")).alias("kth")), "queries")
        start, stop = stop, 3 * stop
    if found is None:
        return spark.createDataFrame([], "subject_id bigint, id bigint, similarity double")
    return found
