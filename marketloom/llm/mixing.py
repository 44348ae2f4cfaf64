"""Mixing sources to target weights by the cube method.

Each source's target is a multiple of its size, so each of its documents is taken a whole number of times plus,
with one inclusion probability, once more. The cube method turns the probabilities into decisions: in blocks of
a source, random steps in the null space of the balancing constraints (words and documents of the block) fix
one document after the other without changing the block's totals; each block leaves two undecided at most.
Those of many blocks form the next blocks, until one block of the source is left, and its last few documents
are the landing problem. Blocks are bounded, made by a hash of doc_id, and seeded by their key.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, keyed, table, word_count
from marketloom.llm.tokens import release

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    The rows are sorted in one task, so sources are to be few (some million names and sums at most).

    Sources in code-point order, null last, take the weights in turn and share ``share`` of all sizes; a target
    stops at ``cap`` times the source's size and what is over is shared again by weight. That is water filling:
    sources reach their cap in the order of size per weight, and the level of the rest follows from the sums
    before them.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    by_level = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    return (
        sizes.withColumn("_w", w)
        .withColumns(
            {
                "_total": F.lit(share) * F.sum("source_size").over(everything),
                "_weights": F.sum("_w").over(everything),
                "_full": F.coalesce(F.lit(cap) * F.sum("source_size").over(before), F.lit(0.0)),
                "_full_w": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
            }
        )
        .withColumn("_level", (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_full_w")))
        .withColumn("_open", F.lit(cap) * F.col("source_size") > F.col("_level") * F.col("_w"))
        # The first source in this order that stays under its cap sets the level of all after it.
        .withColumn("_level", F.min(F.when(F.col("_open"), F.struct(F.col("_full_w").alias("k"), F.col("_level").alias("v")))).over(everything)["v"])
        .select(
            "source",
            "source_size",
            F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("_level") * F.col("_w"), F.lit(cap) * F.col("source_size"))).cast("double").alias("target"),
        )
    )


def flight(pi: list[float], size: list[int], rng: random.Random) -> list[int]:
    """Random steps that keep sum(pi) and sum(pi * size) until two units at most are undecided: their places."""
    live: list[int] = []
    for k in range(len(pi)):
        if 1e-9 < pi[k] < 1 - 1e-9:
            live.append(k)
        else:
            pi[k] = float(round(pi[k]))
        while len(live) == 3:
            a, b, c = live
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])  # orthogonal to (1, 1, 1) and the sizes
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - pi[i]) / x if x > 0 else -pi[i] / x for i, x in zip(live, u, strict=True) if x)
            down = min(pi[i] / x if x > 0 else (pi[i] - 1) / x for i, x in zip(live, u, strict=True) if x)
            step = up if rng.random() * (up + down) < down else -down
            keep = []
            for i, x in zip(live, u, strict=True):
                pi[i] += step * x
                if pi[i] < 1e-9 or pi[i] > 1 - 1e-9:
                    pi[i] = float(round(pi[i]))
                else:
                    keep.append(i)
            live = keep
    return live


def landing(live: list[int], pi: list[float], size: list[int]) -> None:
    """Decide the last units, then turn over single decisions while that brings the words nearer to what the
    probabilities promise: long documents left at the end would else miss the target by half their size."""
    want = sum(pi[i] * size[i] for i in live)
    best = min(
        itertools.product((0.0, 1.0), repeat=len(live)),
        key=lambda take: abs(sum(x * size[i] for x, i in zip(take, live, strict=True)) - want),
    )
    over = sum(x * size[i] for x, i in zip(best, live, strict=True)) - want
    for i, x in zip(live, best, strict=True):
        pi[i] = x
    for _ in range(8):
        turn = [i for i in range(len(pi)) if size[i] and (pi[i] == 1.0) == (over > 0)]
        if not turn:
            return
        i = min(turn, key=lambda i: abs(abs(over) - size[i]))
        if abs(abs(over) - size[i]) >= abs(over):
            return
        over += size[i] if over < 0 else -size[i]
        pi[i] = 1.0 - pi[i]


def decide(pdf: pd.DataFrame, last: bool, seed: int) -> pd.DataFrame:
    release()
    # Long documents first, so that short ones are left for the end; ties by hash, then id.
    pdf = pdf.sort_values(["size", "_hash", "_id"], ascending=[False, True, True], kind="stable")
    rng = random.Random(f"{seed}/{int(pdf['_hash'].iloc[0])}/{len(pdf)}")
    pi, size = pdf["_pi"].tolist(), pdf["size"].tolist()
    live = flight(pi, size, rng)
    if last and live:
        landing(live, pi, size)
    return pdf.assign(_pi=np.array(pi, float))


def decider(last: bool, seed: int):
    return lambda pdf: decide(pdf, last, seed)


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, block: int = 500, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of each document.

    ``size`` is the number of words, ``copies`` how often the mix takes the document (0, 1 or 2 with cap 2) and
    ``taken`` the words so taken. Null or empty texts have size 0, and are taken by the same chance. A null
    source is a source of its own, the last. Rows of a repeated or null doc_id are decided one by one, each with a
    row number, so that they spread over the blocks too. Reruns agree whatever the partitions, as blocks depend on
    these keys and the number of rows alone. A source may hold nearly all rows: only its blocks meet in a task. An
    empty table gives no rows; columns besides ``doc_id``, ``text`` and ``source`` are not read.
    """
    return _mix(*keyed(docs), share, cap, weights, block, seed).drop("_id")


def _mix(docs: DataFrame, key: str, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, block: int = 500, seed: int = 7) -> DataFrame:
    """``mix`` of rows that ``key`` tells apart, with this key as ``_id``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("_id"), "doc_id", source.alias("source"), word_count(F.col("text")).alias("size"))
    rows = scratch.save(rows, "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    shares = scratch.save(targets(per.select("source", "source_size"), share, cap, weights), "targets")
    buckets = max(1, -(-rows.count() // block))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio + 1e-12), F.lit(int(cap)))
    state = rows.join(shares.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")))
    state = state.select(
        "_id", "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"),
        "size", "source_size", "target", whole.alias("_whole"),
        F.greatest(ratio - whole, F.lit(0.0)).alias("_pi"),
        F.xxhash64("_id", F.lit(seed)).alias("_hash"),
    ).withColumn("_block", F.pmod(F.shiftright("_hash", 3), F.lit(buckets)))
    schema = state.schema
    decided: list[DataFrame] = []
    while True:
        last = buckets == 1
        state = scratch.save(state.groupBy("_key", "_block").applyInPandas(decider(last, seed), schema), "flight")
        undecided = (F.col("_pi") > 0) & (F.col("_pi") < 1)
        decided.append(state.filter(~undecided))
        if last:
            break
        buckets = -(-buckets // max(2, block // 2))
        state = state.filter(undecided).withColumn("_block", F.pmod("_block", F.lit(buckets)))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    copies = (F.col("_whole") + F.round("_pi").cast("long")).cast("long")
    return out.select(
        "_id", "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns.

    Rows are taken one by one, those without a doc_id or with a repeated one by their numbers. What is taken meets
    the rows by a sort-merge join on this unique key, at every size. An empty table gives no rows; null and empty
    texts are taken by the same chance as others.
    """
    rows, key = keyed(docs)
    take = _mix(rows, key, **options).filter("copies > 0").select("_id", F.col("copies").cast("int").alias("_copies"))
    take = Scratch(docs.sparkSession, "mixing").save(take, "taken")
    return (
        rows.join(take.hint("merge"), F.col(key) == F.col("_id"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(docs.columns)
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")
