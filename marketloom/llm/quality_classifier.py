"""Quality classifier: a factorisation machine over hashed words and the structure of a text.

A text becomes a sparse vector: hashed word shapes and words, weighted by their share, and a few structure
statistics (length, symbols, capitals, lines, repeats), which are the metadata it carries itself; its labels,
language, source and id are never inputs. The score is
``sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])``: the last term is the sum over all
pairs ``<v_i, v_j> x_i x_j``, in time linear in the non-zero features. The model is fitted on the driver from a
sample of at most ``max_rows`` labelled rows, chosen by a hash of the id; scoring is one pass over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import table
from marketloom.llm.tokens import text_blocks

BITS = 15
STATS = 12
SIZE = (1 << BITS) + STATS
_symbols = re.compile(r"[#*$%&|<>]")
_capitals = re.compile(r"[A-ZÀ-Þ]")
_letters = re.compile(r"[^\W\d_]")


def statistics(text: str, words: list[bytes]) -> list[float]:
    """Structure of a text as numbers of about 0 to 1."""
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    per = 1.0 / max(1, chars)
    return [
        1.0,
        np.log1p(n) / 10,
        np.log1p(chars) / 12,
        min(2.0, len(_symbols.findall(text)) / max(1, n)),
        len(_capitals.findall(text)) * per,
        1 - len(_letters.findall(text)) * per,
        sum(map(str.isdigit, text)) * per * 4,
        min(2.0, text.count("!") / max(1, n) * 2),
        1 - len(set(words)) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        min(2.0, chars / max(1, n) / 12),
        min(2.0, len(lines) / max(1, n) * 4),
    ]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the sparse vectors, sorted by row. Every row has its statistics."""
    rows, cols, vals = [], [], []
    digest = xxhash.xxh32_intdigest
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "replace").split()
        stats = statistics(text, words)
        hashed = np.fromiter(map(digest, words), np.int64, len(words)) & ((1 << BITS) - 1)
        ids, counts = np.unique(hashed, return_counts=True)
        weight = np.sqrt(counts)
        weight /= max(1e-9, np.sqrt((weight**2).sum()))
        cols += [ids, np.arange(SIZE - STATS, SIZE)]
        vals += [weight, np.array(stats)]
        rows.append(np.full(len(ids) + STATS, k))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The margin of each row, and the sums of v * x that the gradient needs."""
        if not n:
            return np.zeros(0), np.zeros((0, self.v.shape[1]))
        firsts = np.searchsorted(rows, np.arange(n))
        xv = self.v[cols] * vals[:, None]
        sums = np.add.reduceat(xv, firsts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(xv**2, firsts)).sum(1)
        return self.bias + np.add.reduceat(self.w[cols] * vals, firsts) + pairs, sums

    def score(self, texts: list[str]) -> np.ndarray:
        margin, _ = self.margin(*features(texts), len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.05, l2: float = 1e-5, seed: int = 5) -> FactorisationMachine:
    """Minimise the log loss by Adagrad over small batches; the order depends on the seed alone."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98))
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)))
    if not len(texts):
        return model
    rows, cols, vals = features(texts)
    firsts = np.append(np.searchsorted(rows, np.arange(len(texts))), len(rows))
    seen_w, seen_v = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 64):
            batch = order[a : a + 64]
            at = np.concatenate([np.arange(firsts[k], firsts[k + 1]) for k in batch])
            own = np.repeat(np.arange(len(batch)), firsts[batch + 1] - firsts[batch])
            c, x = cols[at], vals[at]
            margin, sums = model.margin(own, c, x, len(batch))
            gap = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) / len(batch)
            model.bias -= rate * gap.sum()
            used, inverse = np.unique(c, return_inverse=True)
            g = np.bincount(inverse, gap[own] * x) + l2 * model.w[used]
            seen_w[used] += g**2
            model.w[used] -= rate * g / np.sqrt(seen_w[used])
            each = (gap[own] * x)[:, None] * (sums[own] - model.v[c] * x[:, None])
            gv = np.stack([np.bincount(inverse, each[:, f]) for f in range(rank)], 1) + l2 * model.v[used]
            seen_v[used] += gv**2
            model.v[used] -= rate * gv / np.sqrt(seen_v[used])
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 40_000_000) -> FactorisationMachine:
    """A model from labelled rows outside the held-out fold (crc32 of doc_id as text, modulo 5, is 0).

    At most ``max_rows`` documents, the first by a hash of the id, and of these as many as ``max_chars`` characters of
    whole texts allow: the documented bound of the sample. Texts of over a fortieth of ``max_chars`` are left out of it.
    Both bounds are applied to lengths, before any text is fetched. A document's label is the largest of its rows; of
    several texts of one doc_id the shortest is taken, then that of the smallest digest. Null texts count as empty.
    Without usable labels the model gives 0.5 to every text.
    """
    usable = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = usable.withColumn("_o", order).orderBy("_o", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = F.struct(F.length("text").alias("n"), F.sha2("text", 256).alias("d"))
    lengths = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "_o").agg(F.min(own).alias("t"))
    lengths = lengths.filter(F.col("t.n") <= max_chars // 40)
    so_far = F.sum("t.n").over(Window.orderBy("_o", "doc_id"))  # at most max_rows rows
    picked = lengths.withColumn("_sum", so_far).filter(F.col("_sum") <= max_chars).select("doc_id", "quality", "_o", F.col("t.d").alias("_d"))
    texts = rows.join(F.broadcast(picked), "doc_id").filter(F.sha2("text", 256) == F.col("_d")).dropDuplicates(["doc_id"])
    sample = sorted(texts.collect(), key=lambda r: (r["_o"], r["doc_id"]))
    return fit([r["text"] for r in sample], np.array([r["quality"] for r in sample], float))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; null counts as empty and gets a score too.

    Repeated rows each get their row, equal texts equal scores; very long texts are scored whole, in blocks of rows.
    An empty table gives no rows; columns besides ``doc_id`` and ``text`` are not read. The model (a few MB, of fixed size) is broadcast; texts are scored where they are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(texts) for _, texts in text_blocks(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"]
            )

    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(run, "doc_id bigint, score double")
        .select(
            "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
        )
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
