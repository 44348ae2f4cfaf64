"""Importance resampling towards a target by hashed word features.

Each text is counted into hash buckets. The counts of many texts form a sparse matrix, documents by buckets, that is
persisted in blocks of compressed sparse rows. Column sums of the blocks give the distribution of a table; gains of
buckets (log ratios of target and source) times the matrix give each document's weight. Weights with Gumbel noise
draw documents without replacement: the highest scores are the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.byte_words import LOWER, byte_class, crc_of, text_bytes, word_bounds
from marketloom.llm.common import Scratch, small_batches, table
from marketloom.llm.tokens import arrow_blocks

#: Letters, digits and all characters beyond ASCII make words; A-Z are read in lower case.
WORD_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: A block of the matrix: row r holds indices[indptr[r] : indptr[r + 1]] with their counts.
#: Texts of about so many bytes make a block. Readers decode a whole row group of a matrix at once, and writers close one after a
#: hundred rows at the earliest, so both are small: what a task holds does not depend on the size of its split.
BLOCK_BYTES = 256_000
ROW_GROUP = {"parquet.block.size": 4 << 20}
CSR = "doc_id array<bigint>, n_words array<bigint>, indptr array<int>, indices array<int>, counts array<int>"


def bucket_counts(texts: pa.Array, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text and the sparse rows of its features: every run of 1 to ``runs`` words, joined by a space."""
    data, offsets = text_bytes(texts)
    starts, stops, doc = word_bounds(data, offsets, WORD_BYTES)
    data = np.append(LOWER[data], np.uint8(32))  # the last byte stands for the space between words
    n_words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    crc, keys = None, []
    for run in range(1, runs + 1):
        n = len(starts) - run + 1
        if n <= 0:
            break
        if crc is not None:
            space = np.full(n, len(data) - 1)
            crc = crc_of(data, space, space + 1, crc[:n])
        crc = crc_of(data, starts[run - 1 :], stops[run - 1 :], crc)
        own = doc[run - 1 :] == doc[:n]  # all words of the run lie in one text
        keys.append(doc[:n][own] * buckets + (crc[own] % np.uint32(buckets)).astype(np.int64))
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    cells = keys[first]
    indptr = np.searchsorted(cells, np.arange(len(texts) + 1) * buckets)
    return n_words, indptr.astype(np.int32), (cells % buckets).astype(np.int32), counts.astype(np.int32)


def count_matrix(docs: DataFrame, runs: int = 1, buckets: int = 10_000, key: str = "doc_id") -> DataFrame:
    """The document-by-bucket counts of ``docs`` as blocks of compressed sparse rows (``CSR``).

    One pass in the tasks that read the texts. A block holds the texts of about ``BLOCK_BYTES``, or one longer text. Null and empty
    texts are rows without cells; null and repeated keys are rows of their own. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in arrow_blocks(batch, 1, BLOCK_BYTES):
                n_words, indptr, indices, counts = bucket_counts(texts, runs, buckets)
                columns = [batch.column(0).slice(start, len(texts)), n_words, indptr, indices, counts]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, t))
                        for c, t in zip(columns, types, strict=True)
                    ],
                    ["doc_id", "n_words", "indptr", "indices", "counts"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, CSR)


def list_values(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    return batch.column(name)[row].values


def column_sums(matrix: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all documents. Tasks add their blocks up; ``buckets`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                indices, counts = (list_values(batch, c, k).to_numpy() for c in ("indices", "counts"))
                np.add.at(total, indices, counts.astype(np.int64))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["bucket", "n"])

    sums = matrix.select("indices", "counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    with small_batches(matrix.sparkSession):
        rows = sums.collect()
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target and in the source, one count added to each."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the matrix times ``gain``, as the floored mean over a row's features.

    A row without features weighs 0. The vector has one number a bucket and is sent to all tasks.
    """
    held = matrix.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                indptr, indices, counts = (list_values(batch, c, k).to_numpy() for c in ("indptr", "indices", "counts"))
                counts = counts.astype(np.int64)
                both = [np.append(0, np.cumsum(x))[indptr] for x in (counts, counts * held.value[indices])]
                n, total = (np.diff(x) for x in both)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [list_values(batch, "doc_id", k), list_values(batch, "n_words", k), pa.array(n), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return matrix.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel value that depends on ``seed`` and the key alone. A null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, scratch: Scratch, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, ... for the drawn documents, null for all others.

    Of the N rows with enough words, floor(percent * N / 100) are drawn by score, ties by doc_id (null last). Counts by score
    find the lowest score that is drawn; scores are whole thousandths between doubles' logarithms, at most some 100,000
    values, whatever the number of rows. Rows at or above it are sorted by ranges, and a row's rank is its place in its
    range after all ranges before.
    """
    able = F.col("n_words") >= least_words
    by_score = sorted(((r.score, r.n) for r in scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    most = percent * sum(n for _, n in by_score) // 100
    cut, met = None, 0
    for score, n in by_score:
        if met >= most:
            break
        cut, met = score, met + n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    placed = scratch.save(scored.filter(near).orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_place") - F.shiftleft("_part", 33) + 1
    drawn = placed.join(F.broadcast(before), "_part").withColumn("rank", F.when(rank <= most, rank)).select(*scored.columns, "rank")
    return drawn.union(scored.filter(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    runs: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null where it isn't drawn.

    ``target`` has texts to come near to. Texts are counted once; the matrix is a staged table, read twice. Null and empty
    texts have no features, weigh 0 and are not drawn. Rows of a repeated doc_id share its noise and are drawn one by
    one; a null doc_id counts as an empty text there and comes last in ties. Very long texts are counted whole. Empty
    tables give no rows; an empty target is a flat one. Extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    matrix = scratch.save(count_matrix(docs, runs, buckets), "matrix", **ROW_GROUP)
    goal = scratch.save(count_matrix(target.withColumn("doc_id", F.lit(0)), runs, buckets), "target", **ROW_GROUP)
    gain = gains(column_sums(goal, buckets), column_sums(matrix, buckets))
    scored = weigh(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scratch.save(scored, "scored"), scratch, percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE k = 8),
words AS (
  SELECT true AS ours, row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT false, row_number() OVER (), NULL,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), each AS (SELECT ours, r, unnest(w) AS f FROM words),
hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM each)),
bucket AS (
  SELECT f, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS b
  FROM hexes, crc
), cells AS (SELECT ours, r, b, count(*) AS n FROM each JOIN bucket USING (f) GROUP BY ALL),
sums AS (SELECT b, coalesce(sum(n) FILTER (ours), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT ours), 0)::DOUBLE AS t FROM cells GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS g FROM sums),
weights AS (SELECT r, sum(n * g)::BIGINT AS total FROM cells JOIN gain USING (b) WHERE ours GROUP BY r),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features,
    CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM words LEFT JOIN weights USING (r) WHERE ours
), placed AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS able,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features, weight) AS place,
    sum((n_features >= 20)::INT) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (10 * n) // 100 THEN place END::BIGINT AS rank FROM placed
"""
