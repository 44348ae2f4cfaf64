"""How the word use of sources differs, language by language.

Terms are counted by (language, source) in Arrow batches. For every two sources of a language, the tasks that hold a
term's counts tally which combinations (count in one, count in the other) occur and how often; cells with a zero follow
from the margins. A difference of smoothed shares is then evaluated once a combination and multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.byte_words import LOWER, byte_class, text_bytes
from marketloom.llm.common import Scratch, table
from marketloom.llm.tokens import arrow_blocks

#: Letters and all characters beyond ASCII make terms; A-Z are read in lower case, every other byte parts two terms.
TERM_BYTES = byte_class((0x41, 0x5A), (0x61, 0x7A))
SPACED = np.where(TERM_BYTES, LOWER, 32).astype(np.uint8)
#: A share of 1 is this many units.
UNITS = 1_000_000_000
#: Sources of a language that one row of counts holds at most about; more are dealt out by hash.
BLOCK = 256
#: Pairs that a task expands at once, and entries that it adds up before it hands them on.
PAIRS, ENTRIES = 1_000_000, 1_500_000


class Tally:
    """Sums of rows of numbers by an integer key, added up within bounds."""

    def __init__(self, width: int) -> None:
        self.keys: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.width, self.held = width, 0

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.keys.append(keys)
        self.rows.append(rows)
        self.held += len(keys)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        rows = np.concatenate([np.zeros((0, self.width), np.int64), *self.rows])
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, rows = keys[first], np.add.reduceat(rows, first) if len(first) else rows
        self.keys, self.rows, self.held = [keys], [rows], len(keys)
        return keys, rows


class TermCounter:
    """Occurrences and documents of terms by group; numbers of terms and groups are the task's own."""

    def __init__(self) -> None:
        self.term: dict[str, int] = {}
        self.group: dict[tuple[str, str], int] = {}
        self.tally = Tally(2)

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        data, offsets = text_bytes(texts)
        held = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(SPACED[data])])
        parts = pc.split_pattern(held, " ")
        coded = parts.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        number = np.fromiter((self.term.setdefault(t, len(self.term)) if t else -1 for t in names), np.int64, len(names))
        term = number[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        lens = np.diff(parts.offsets.to_numpy())
        doc = np.repeat(np.arange(len(texts)), lens)
        doc, term = doc[term >= 0], term[term >= 0]
        group = np.fromiter((self.group.setdefault(g, len(self.group)) for g in zip(langs, sources, strict=True)), np.int64, len(texts))
        cells, n = np.unique((doc << 40) | term, return_counts=True)
        self.tally.add(((cells & ((1 << 40) - 1)) << 24) | group[cells >> 40], np.stack([n, np.ones(len(n), np.int64)], 1))

    def full(self) -> bool:
        if self.tally.held > ENTRIES:
            self.tally.sums()
        return len(self.term) > ENTRIES or self.tally.held > ENTRIES // 2 or len(self.group) > 1 << 20

    def batch(self) -> pa.RecordBatch:
        keys, rows = self.tally.sums()
        terms = pa.array(list(self.term), pa.string()).take(pa.array(keys >> 24))
        groups = pa.array(keys & ((1 << 24) - 1))
        lang, source = (pa.array([g[k] for g in self.group], pa.string()).take(groups) for k in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a group, and the group's documents that hold it.

    Tasks add up what they read, within bounds, so partial rows are few; they are summed after one shuffle by (lang,
    term), which leaves all sources of a term in one place. Null text, lang and source count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter()
        for batch in batches:
            for start, texts in arrow_blocks(batch, 2):
                lang, source = (batch.column(k).slice(start, len(texts)).to_pylist() for k in (0, 1))
                counter.add(texts, lang, source)
                if counter.full():
                    yield counter.batch()
                    counter = TermCounter()
        yield counter.batch()

    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def joint_counts(cells: DataFrame) -> DataFrame:
    """``lang, a, b, ca, cb, m``: how many terms occur ``ca`` times in source ``a`` and ``cb`` times in ``b``, for every two
    sources a < b of a language that share a term. ``cells`` has rows (lang, across, cells) with ``cells`` sorted by source;
    where ``across`` is set, only pairs of different ``block`` are met in that row. Tallied inside tasks, PAIRS at a time."""

    def tally(lang: pa.Array, across: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
        lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        source = flat.field("source").dictionary_encode()
        code, n = source.indices.to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
        block = flat.field("block").to_numpy()
        lang = lang.dictionary_encode()
        row = np.repeat(np.arange(len(lens)), lens)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        partners = lens[row] - 1 - place
        left = np.repeat(np.arange(len(row)), partners)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners)
        keep = ~across[row[left]] | (block[left] != block[right])
        left, right = left[keep], right[keep]
        values, level = np.unique(n, return_inverse=True)
        k, s = len(values), len(source.dictionary)
        pair = (lang.indices.to_numpy().astype(np.int64)[row[left]] * s + code[left]) * s + code[right]
        pairs, pair = np.unique(pair, return_inverse=True)
        combos, m = np.unique((pair * k + level[left]) * k + level[right], return_counts=True)
        of = pairs[combos // (k * k)] if len(combos) else combos
        names = [lang.dictionary.take(pa.array(of // (s * s))), *(source.dictionary.take(pa.array(x)) for x in (of // s % s, of % s))]
        return pa.RecordBatch.from_arrays(
            [*names, pa.array(values[combos // k % k]), pa.array(values[combos % k]), pa.array(m)], ["lang", "a", "b", "ca", "cb", "m"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            work = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) ** 2 // 2)
            start = 0
            while start < len(work):
                done = work[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(work, done + PAIRS, "right")))
                across = batch.column(1).slice(start, stop - start).to_numpy(zero_copy_only=False)
                yield tally(batch.column(0).slice(start, stop - start), across, lists.slice(start, stop - start))
                start = stop

    found = cells.mapInArrow(run, "lang string, a string, b string, ca bigint, cb bigint, m bigint")
    return found.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (count + 5) / (total + 5 * terms)), exact: decimals hold what overflows a long."""
    above = F.lit(UNITS).cast("decimal(10,0)") * (count + 5).cast("decimal(19,0)")
    below = (total + 5 * terms).cast("decimal(19,0)")
    return F.call_function("div", above, below) + 1


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: in part ``pair``, the distance of each source to every other one of its
    language; in part ``term``, the ``top`` terms that it uses more than the language does.

    Null text, lang and source count as ''. A group whose documents have no kept term has even shares, so it is near to none
    and far from none by name; a language without kept terms gives distances of 0. Ties are ranked by item. Repeated rows
    count as often; texts of any length are read whole; an empty table gives no rows; extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counted = scratch.save(term_counts(docs), "terms")
    kept = counted.groupBy("lang", "term").agg(
        F.sum("n").alias("all_n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells")
    )
    kept = scratch.save(kept.filter(F.col("docs") >= least_docs).drop("docs"), "kept")
    flat = kept.select("lang", "term", "all_n", F.inline("cells"))

    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    by_group = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "own", "v", "lang_n")]
    groups = scratch.save(named.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", *zero), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    joint = scratch.save(joint_counts(dealt(kept, -(-most // BLOCK))), "joint")

    value = pair_distances(joint, flat, groups)
    both = value.select("lang", F.inline(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item"), "value") for x, y in ("ab", "ba")))))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = both.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by_rank))
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("all_n"), F.col("lang_n"), F.col("v"))
    terms = flat.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
    terms = terms.filter("value > 0").withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return pairs.select(*columns).union(terms.select(*columns))


def dealt(kept: DataFrame, blocks: int) -> DataFrame:
    """Rows of counts for ``joint_counts``. With several blocks of sources, every two blocks of a term make a row, so no row
    grows with the number of sources."""
    block = F.lit(0) if blocks == 1 else F.pmod(F.hash("source"), F.lit(blocks))
    if blocks == 1:
        cells = F.transform("cells", lambda c: F.struct(c["source"].alias("source"), c["n"].alias("n"), F.lit(0).alias("block")))
        return kept.select("lang", F.lit(False).alias("across"), cells.alias("cells"))
    flat = kept.select("lang", "term", F.inline("cells")).withColumn("block", block)
    flat = flat.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    flat = flat.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    met = flat.groupBy("lang", "term", "low", "high").agg(F.array_sort(F.collect_list(F.struct("source", "n", "block"))).alias("cells"))
    return met.select("lang", (F.col("low") != F.col("high")).alias("across"), "cells")


def pair_distances(joint: DataFrame, flat: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for every two sources a < b of a language: differences of shares summed over all its kept terms.

    Cells (c, 0) and (0, c) are a margin's terms of count c less those met in the joint tally; (0, 0) is what remains.
    """
    margin = flat.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    left, right = (groups.select("lang", F.col("source").alias(x), F.col("own").alias(f"own_{x}"), F.col("total").alias(f"total_{x}"), "v") for x in "ab")
    pairs = left.join(right.drop("v"), "lang").filter("a < b")
    key = ["lang", "a", "b"]
    zero = F.lit(0).cast("long")
    met = joint.select(*key, F.inline(F.array(
        F.struct("ca", "cb", "m"), F.struct("ca", zero.alias("cb"), (-F.col("m")).alias("m")),
        F.struct(zero.alias("ca"), "cb", (-F.col("m")).alias("m")), F.struct(zero.alias("ca"), zero.alias("cb"), "m"),
    )))
    of_a = pairs.select(*key).join(margin.select("lang", F.col("source").alias("a"), F.col("n").alias("ca"), "m"), ["lang", "a"])
    of_b = pairs.select(*key).join(margin.select("lang", F.col("source").alias("b"), F.col("n").alias("cb"), "m"), ["lang", "b"])
    rest = pairs.select(*key, zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("own_a") - F.col("own_b")).alias("m"))
    cells = met.unionByName(of_a.withColumn("cb", zero)).unionByName(of_b.withColumn("ca", zero)).unionByName(rest)
    cells = cells.groupBy(*key, "ca", "cb").agg(F.sum("m").alias("m")).filter("m > 0")
    f = F.abs(share(F.col("ca"), F.col("total_a"), F.col("v")) - share(F.col("cb"), F.col("total_b"), F.col("v")))
    value = cells.join(pairs, key).groupBy(*key).agg(F.sum(f * F.col("m")).alias("value"))
    return pairs.select(*key).join(value, key, "left").select(*key, F.coalesce("value", zero).alias("value"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b USING (lang) LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  WHERE a.source <> b.source
), parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
) WHERE part = 'pair' OR rank <= 50
"""
