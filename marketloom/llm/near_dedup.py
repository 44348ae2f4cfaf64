"""Near-duplicate groups by SetSketch registers, banding, joint likelihood and exact checks.

A document is the set of its word shingles. Its sketch holds, for each of many hash functions, the minimum of
exponential hash values over the set, stored as a truncated exponent of a base close to 1; sketches of parts merge by
the maximum of each register. Two sets share a register with about the probability of their Jaccard
similarity, so documents that agree in a whole band of registers are candidates. From two sketches and the
known set sizes the similarity is estimated by maximum likelihood; candidates that are clearly below the limit
are left out and the others are compared on their full sets.

Copies are merged first, as equal sets. Within a bucket all members meet one pivot only, the member with the
fewest shingles of its own; what the pivot's component has taken in needs no more comparison, and only members
outside it then meet the rest of their bucket. In large buckets, two exact bounds drop members before that:
the shingles that a document shares with no other document of a large bucket cannot be part of any overlap
there, and an overlap outside the pivot is bounded by what each has outside it. So a group of copies, exact or near, costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, keyed, table, without
from marketloom.llm.tokens import release, text_blocks


@dataclass(frozen=True)
class NearOptions:
    """``shingle`` words; ``similarity`` in per cent; ``registers`` in bands of ``rows``; buckets of over ``small``
    members count as large. A candidate is left out unchecked if its estimate is ``margin`` below the limit (at 128
    registers, over five standard deviations)."""

    shingle: int = 5
    similarity: int = 80
    registers: int = 128
    rows: int = 4
    small: int = 16
    margin: float = 0.22


#: Base and scale of the registers (16 bits hold sets of any size at these).
BASE, SCALE, TOP = 1.001, 20.0, 65535
_rng = np.random.default_rng(20)
_xor = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2)
_odd = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, no words none."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64) if len(h) else h
    n = len(h) - k + 1
    out = h[:n]
    for j in range(1, k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """A row of uint16 registers for each non-empty set."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    low = np.empty((len(sets), registers), np.uint64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    firsts = np.cumsum(lengths) - lengths
    # Blocks that fit the cache; a set that crosses blocks takes the smaller of both minima.
    low[:] = np.uint64(2**64 - 1)
    step = 1 << 15
    for a in range(0, len(flat), step):
        b = min(a + step, len(flat))
        i = int(np.searchsorted(firsts, a, "right")) - 1
        j = int(np.searchsorted(firsts, b, "left"))
        at = np.maximum(firsts[i:j] - a, 0)
        part = flat[a:b]
        for r in range(registers):
            low[i:j, r] = np.minimum(low[i:j, r], np.minimum.reduceat((part ^ _xor[r]) * _odd[r], at))
    smallest = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-15))
    exponent = np.floor(1 - np.log(np.maximum(smallest, 1e-300) / SCALE) / np.log(BASE))
    return np.clip(exponent, 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p_more, p_less = p(u - v * j), p(v - u * j)
        return more * np.log(p_more) + less * np.log(p_less) + same * np.log(np.clip(1 - p_more - p_less, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        x, y = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = likelihood(x) >= likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def _sketched(docs: DataFrame, o: NearOptions) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, texts in text_blocks(batch, 1):
                sets = [shingle_set(t, o.shingle) for t in texts]
                full = [s for s in sets if len(s)]
                rows = iter(sketches(full, o.registers))
                sketch = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sketch, pa.binary())],
                    ["doc_id", "n", "digest", "sketch"],
                )

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, n bigint, digest binary, sketch binary")


def _sets(docs: DataFrame, ids: DataFrame, o: NearOptions) -> DataFrame:
    """``id, set`` of some documents, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, texts in text_blocks(batch, 1):
                sets = [pa.array(shingle_set(t, o.shingle).view(np.int64)) for t in texts]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(sets) if sets else pa.array([], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), flat], ["id", "set"])

    chosen = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(
        ids.hint("merge"), "id", "left_semi"
    )
    return chosen.mapInArrow(run, "id bigint, set array<bigint>")


def _fits(n_a: str, n_b: str, c_a: str, c_b: str, s: int):
    """Whether two sets of these sizes, with at most these shared shingles, can reach the similarity."""
    a, b = F.col(n_a), F.col(n_b)
    return (100 * F.least(a, b) >= s * F.greatest(a, b)) & ((100 + s) * F.least(c_a, c_b) >= s * (a + b))


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch, o: NearOptions) -> DataFrame:
    """Pairs ``a, b`` that pass the estimate, with ``common``, the size of their sets' overlap, and ``linked``."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = [
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, o.registers) for i in (4, 5)
            ]
            n = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3)]
            near = joint_similarity(*regs, *n) >= o.similarity / 100 - o.margin
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], ["a", "b"]
            )

    def side(x: str) -> DataFrame:
        return nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    close = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    close = scratch.save(close.mapInArrow(estimate, "a bigint, b bigint"), "estimated")
    both = close.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    linked = (100 * common >= o.similarity * union).alias("linked")
    return scratch.save(both.select("a", "b", common.cast("long").alias("common"), linked), "links")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component`` of every linked id: the smallest id that its links reach.

    Large and small stars by turns: neighbours move to the smallest neighbour, until all hang from the smallest
    of their component. Each step is an aggregation and a join, and is written out.
    """
    edges = scratch.save(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    mark = None
    for _ in range(100):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        edges = scratch.save(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle in 100 rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")


def near_groups(docs: DataFrame, o: NearOptions = NearOptions()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if their sets reach the similarity; a component holds all that links reach, and its
    smallest doc_id stays. Null, empty and blank texts have no shingles and are linked with nothing. Rows of a
    repeated or null doc_id are compared one by one; a component without any doc_id has a null ``component_id``.
    Empty tables give no rows; columns besides ``doc_id``, ``text`` and ``source`` are not read.

    A pair at the limit agrees in none of the bands with a probability of 5e-11 at 85 % and 5e-8 at 80 %;
    nothing else is left to chance: buckets have no cap.
    """
    rows, key = keyed(docs)
    groups = _groups(rows.select(F.col(key).alias("doc_id"), "text"), o)
    if key != "doc_id":
        # Rows are numbered in the order of doc_id, so the smallest row of a component has its smallest doc_id.
        groups = Scratch(docs.sparkSession, "near-dedup").save(groups, "groups")
        own = rows.select(F.col(key).alias("_own"), F.col("doc_id").alias("_doc"))
        least = own.toDF("_least", "_component")
        groups = groups.join(own, F.col("doc_id") == F.col("_own")).join(least, F.col("component_id") == F.col("_least"))
        groups = groups.select(F.col("_doc").alias("doc_id"), "n_shingles", F.col("_component").alias("component_id"))
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _groups(docs: DataFrame, o: NearOptions) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of documents that have a doc_id of their own each."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    s = o.similarity
    sketched = scratch.save(_sketched(docs, o), "sketched")
    classes = scratch.save(
        sketched.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id")), "classes"
    )
    reps = scratch.save(
        sketched.filter("n > 0")
        .join(classes, (sketched["doc_id"] == classes["id"]) & (sketched["digest"] == classes["digest"]))
        .select("id", "n", "sketch"),
        "representatives",
    )
    width = 2 * o.rows
    keys = [F.xxhash64(F.lit(k), F.substring("sketch", 1 + width * k, width)) for k in range(o.registers // o.rows)]
    bands = reps.select("id", F.explode(F.array(*keys)).alias("key"))
    shared = scratch.save(bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "keys")
    members = scratch.save(bands.join(shared, "key"), "members")
    ids = scratch.save(members.select("id").distinct(), "candidates")
    sets = scratch.save(_sets(docs, ids, o), "sets")

    # Shingles that another document of a large bucket has too.
    crowded = scratch.save(members.filter(F.col("size") > o.small).select("id").distinct(), "crowded")
    elements = scratch.save(sets.join(crowded, "id", "left_semi").select("id", F.explode("set").alias("x")), "elements")
    common = scratch.save(elements.groupBy("x").agg(F.count("*").alias("k")).filter("k > 1").select("x"), "common")
    bound = scratch.save(elements.join(common, "x").groupBy("id").agg(F.count("*").alias("c")), "bound")
    nodes = reps.join(ids, "id", "left_semi").join(bound, "id", "left")
    nodes = scratch.save(
        nodes.join(crowded.withColumn("in_large", F.lit(True)), "id", "left").select(
            "id", "n", "sketch", F.when(F.col("in_large"), F.coalesce("c", F.lit(0))).otherwise(F.col("n")).alias("c")
        ),
        "nodes",
    )
    m = members.join(nodes.select("id", "n", "c"), "id").withColumn(
        "c", F.when(F.col("size") > o.small, F.col("c")).otherwise(F.col("n"))
    )
    m = scratch.save(m.filter(100 * F.col("c") >= s * F.col("n")).select("key", "id", "n", "c"), "viable")
    pivots = (
        m.groupBy("key")
        .agg(F.max(F.struct((2 * F.col("c") - F.col("n")).alias("r"), (-F.col("id")).alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"))).alias("x"))
        .select("key", (-F.col("x.p")).alias("p"), F.col("x.pn").alias("pn"), F.col("x.pc").alias("pc"))
    )
    pivots = scratch.save(pivots, "pivots")

    def pair(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    stars = m.join(pivots, "key").filter((F.col("id") != F.col("p")) & _fits("n", "pn", "c", "pc", s))
    stars = scratch.save(stars.select(*pair("id", "p")).distinct(), "stars")
    met = _links(stars, nodes, sets, scratch, o)
    links = met.filter("linked").select("a", "b")
    first = scratch.save(components(links, scratch), "first-components")

    # Each member's component, and its overlap with the bucket's pivot where that was measured.
    m = m.join(pivots, "key").withColumns({"a": F.least("id", "p"), "b": F.greatest("id", "p")})
    m = scratch.save(m.join(met.select("a", "b", "common"), ["a", "b"], "left").drop("a", "b"), "measured")
    label = first.select(F.col("id").alias("i"), "component")
    m = m.join(label, m["id"] == label["i"], "left").select(
        "key", "id", "n", "c", "p", F.coalesce("component", "id").alias("g"),
        F.when(F.col("id") == F.col("p"), F.col("n")).otherwise(F.col("common")).alias("o"),
    )
    m = scratch.save(m, "labelled")
    label = first.select(F.col("id").alias("i"), F.col("component").alias("pg"))
    m = m.join(label, m["p"] == label["i"], "left").withColumn("pg", F.coalesce("pg", "p")).drop("i")
    # At most one bucket a band: a pair is looked at in the first bucket that both are in, whatever its outcome there.
    buckets = scratch.save(m.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("in")), "buckets")
    m = scratch.save(m.join(buckets, "id"), "placed")
    # A large bucket's other members are cut into parts of 1024, which meet what is left of it in tasks of their own.
    m = m.join(shared, "key").withColumn("parts", F.ceil(F.col("size") / 1024).cast("int")).drop("size")
    other = [F.col(x).alias(f"v_{x}") for x in ("id", "n", "c", "g", "o", "in")]
    other.append(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    # Outside the pivot an overlap takes shared shingles of both, inside it at most the smaller overlap with it.
    inside = F.coalesce(F.least("o", "v_o") + F.least(F.col("c") - F.col("o"), F.col("v_c") - F.col("v_o")), F.least("c", "v_c"))
    possible = F.when(F.col("o").isNull() | F.col("v_o").isNull(), F.least("c", "v_c")).otherwise(inside)
    rest = (
        m.filter("g <> pg")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(m.select("key", *other), ["key", "part"])
        .filter(
            (F.col("g") != F.col("v_g")) & (F.col("v_id") != F.col("p")) & _fits("n", "v_n", "c", "v_c", s)
            & ((100 + s) * possible >= s * (F.col("n") + F.col("v_n")))
            & ((F.col("v_g") == F.col("pg")) | (F.col("id") < F.col("v_id")))
            & (F.element_at(F.array_intersect("in", "v_in"), 1) == F.col("key"))
        )
    )
    rest = scratch.save(rest.select(*pair("id", "v_id")), "rest")
    more = _links(rest, nodes, sets, scratch, o).filter("linked").select("a", "b")
    final = components(links.unionByName(more), scratch)

    # Classes by component, then documents by class: a hot class meets a plain table, so its rows can be split.
    named = scratch.save(
        classes.join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id")), "named"
    )
    return sketched.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(
        named, "digest", "left"
    ).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, o: NearOptions = NearOptions()) -> DataFrame:
    """The documents that stay, with their own columns: one row of each component, whatever ids its rows have.

    Null, empty and blank texts all stay. An empty table gives no rows.
    """
    rows, key = keyed(docs)
    groups = _groups(rows.select(F.col(key).alias("doc_id"), "text"), o)
    return without(rows, groups.filter("doc_id <> component_id").select("doc_id"), [key]).select(docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), NearOptions(shingle=3, similarity=85))
