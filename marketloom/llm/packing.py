"""Best-fit packing of documents into fixed-length sequences by linear grouping.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There, large pieces are
sorted by length, cut into groups of equal cardinality and rounded up to the longest of their group; the few
sizes left are packed by configurations whose counts come from column generation. Actual lengths then take
the places of the rounded ones, and small pieces go best-fit into what is free. The plan is a list of runs
"pieces of length L with ranks a..b lie at offset o of sequences s..", whose size depends on the number of
lengths, not on that of documents. The pieces are ranked within their length in many buckets at once and look
their run up.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, table
from marketloom.llm.tokens import arrow_blocks, encoder, vocabulary_path

CAPACITY = 2048
#: Fixed value: the id that ends a document.
END_ID = 0


def tokenised(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents: ``doc_id, piece, start, length, ids`` (little-endian uint32 bytes).

    A document is its ids and the end id; null texts count as empty. Only documents longer than ``capacity``
    are cut, into pieces of that length; the first piece takes what is over.
    """
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            keys = batch.column(0)
            for a, texts in arrow_blocks(batch, 1):
                rows, piece, start, length, payload = [], [], [], [], []
                for k, ids in enumerate(encode(texts), a):
                    data = np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes()
                    n = len(data) // 4
                    ends = [*range(n, 0, -capacity)][::-1]
                    begins = [0, *ends[:-1]]
                    rows += [k] * len(ends)
                    piece += range(len(ends))
                    start += begins
                    length += [e - s for s, e in zip(begins, ends, strict=True)]
                    payload += [data[4 * s : 4 * e] for s, e in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(payload, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids binary"
    )


# --- the plan, made from the histogram of lengths ---------------------------------------------------------


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths in falling order cut into groups of equal cardinality: (rounded size, [(length, count)])."""
    total = sum(counts.values())
    share = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    free = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not free:
                out.append((length, []))
                free = share
            take = min(n, free)
            out[-1][1].append((length, take))
            n -= take
            free -= take
    return out


def best_configuration(sizes: list[int], worth: np.ndarray, limit: list[int], capacity: int) -> tuple[float, list[int]]:
    """The multiset of sizes within capacity of most worth: a knapsack with few copies of each size."""
    value = np.zeros(capacity + 1)
    taken: list[np.ndarray] = []
    for size, w, most in zip(sizes, worth, limit, strict=True):
        n = np.zeros(capacity + 1, np.int16)
        if w > 1e-12:
            best = value.copy()
            for k in range(1, min(most, capacity // size) + 1):
                shifted = np.full(capacity + 1, -np.inf)
                shifted[k * size :] = value[: capacity + 1 - k * size] + k * w
                better = shifted > best + 1e-12
                best[better], n[better] = shifted[better], k
            value = best
        taken.append(n)
    at, config = int(np.argmax(value)), [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        config[i] = int(taken[i][at])
        at -= config[i] * sizes[i]
    return float(value.max()), config


def simplex_duals(columns: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min sum(x), columns @ x >= demand, x >= 0: x and the duals, by the dual's simplex tableau.

    The dual, max demand @ y with columns.T @ y <= 1, starts feasible at y = 0.
    """
    m, n = columns.shape
    t = np.zeros((n + 1, m + n + 1))
    t[:n, :m], t[:n, m : m + n], t[:n, -1] = columns.T, np.eye(n), 1.0
    t[n, :m] = -demand
    basis = list(range(m, m + n))
    for step in range(50 * (m + n)):
        costs = t[n, :-1]
        enter = int(np.argmin(costs)) if step < 20 * (m + n) else int(np.argmax(costs < -1e-9))
        if costs[enter] >= -1e-9:
            break
        col = t[:n, enter]
        ratio = np.where(col > 1e-9, t[:n, -1] / np.where(col > 1e-9, col, 1.0), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        t[leave] /= t[leave, enter]
        others = np.arange(n + 1) != leave
        t[others] -= np.outer(t[others, enter], t[leave])
        basis[leave] = enter
    y = np.zeros(m)
    for row, var in enumerate(basis):
        if var < m:
            y[var] = t[row, -1]
    return np.maximum(t[n, m : m + n], 0.0), y


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations of the rounded sizes and how often each is used, covering the demand exactly.

    Column generation solves the relaxed problem; whole parts are taken, and what is left of each size (fewer
    than one sequence for each configuration) is packed by the best knapsack again and again.
    """
    m = len(sizes)
    if not m:
        return []
    d = np.array(demand, float)
    columns = [[capacity // s if i == k else 0 for i in range(m)] for k, s in enumerate(sizes)]
    x = np.zeros(m)
    for _ in range(80):
        x, y = simplex_duals(np.array(columns, float).T, d)
        worth, config = best_configuration(sizes, y, demand, capacity)
        if worth <= 1 + 1e-7 or config in columns:
            break
        columns.append(config)
    left, out = list(demand), []
    for config, n in sorted(zip(columns, x, strict=False), key=lambda c: -c[1]):
        whole = int(n + 1e-9)
        whole = min([whole, *(left[i] // k for i, k in enumerate(config) if k)])
        if whole:
            out.append((config, whole))
            left = [a - k * whole for a, k in zip(left, config, strict=True)]
    while any(left):
        live = [i for i in range(m) if left[i]]
        _, part = best_configuration(
            [sizes[i] for i in live], np.array([sizes[i] for i in live], float), [left[i] for i in live], capacity
        )
        config = [0] * m
        for i, k in zip(live, part, strict=True):
            config[i] = k
        n = min(left[i] // k for i, k in enumerate(config) if k)
        out.append((config, n))
        left = [a - k * n for a, k in zip(left, config, strict=True)]
    return out


class Runs:
    """Sequences that look alike: their lengths so far, how many there are, and the runs placed in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.used: dict[int, int] = defaultdict(int)  # ranks given out of each length
        self.placed: list[tuple[int, int, int, int, int]] = []  # length, rank from, to, first sequence, offset
        self.next = 0
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> [(first sequence, how many)]
        self.rooms: list[int] = []

    def place(self, length: int, n: int, first: int, offset: int) -> None:
        a = self.used[length]
        self.used[length] = a + n
        self.placed.append((length, a, a + n, first, offset))

    def leave(self, room: int, first: int, n: int) -> None:
        if not self.free[room]:
            bisect.insort(self.rooms, room)
        self.free[room].append((first, n))

    def take(self, room: int, n: int) -> tuple[int, int]:
        """Up to n alike sequences with this room: the first, and how many."""
        first, have = self.free[room].pop()
        if have > n:
            self.free[room].append((first + n, have - n))
            have = n
        if not self.free[room]:
            self.rooms.remove(room)
        return first, have


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 48, small: float = 0.25) -> list[tuple]:
    """Runs ``(length, rank_from, rank_to, first_sequence, offset)`` that place every piece once.

    Pieces over ``small * capacity`` are large. Its cost and size follow the number of distinct lengths.
    """
    runs = Runs(capacity)
    counts = {k: n for k, n in counts.items() if n}
    if n := counts.pop(capacity, 0):
        runs.place(capacity, n, 0, 0)
        runs.next = n
    large = {k: n for k, n in counts.items() if k > small * capacity}
    grouped = linear_groups(large, groups)
    queues = [[*reversed(members)] for _, members in grouped]  # longest at the end
    for config, times in configurations(
        [size for size, _ in grouped], [sum(n for _, n in members) for _, members in grouped], capacity
    ):
        slots = [i for i, k in enumerate(config) for _ in range(k)]
        while times:
            # As many sequences as the actual documents of every slot stay of one length.
            need: dict[tuple[int, int], int] = defaultdict(int)
            lengths, ahead = [], {i: [list(x) for x in queues[i][::-1]] for i in set(slots)}
            for i in slots:
                lengths.append(ahead[i][0][0])
                need[i, ahead[i][0][0]] += 1
                ahead[i][0][1] -= 1
                if not ahead[i][0][1]:
                    ahead[i].pop(0)
            have: dict[tuple[int, int], int] = defaultdict(int)
            for i in set(slots):
                for length, n in queues[i]:
                    have[i, length] += n
            n = min([times, *(max(1, have[key] // k) for key, k in need.items())])
            offset = 0
            for i, length in zip(slots, lengths, strict=True):
                runs.place(length, n, runs.next, offset)
                offset += length
                left = n
                while left:  # a length may lie in parts of its group
                    at = next(j for j in range(len(queues[i]) - 1, -1, -1) if queues[i][j][0] == length)
                    got = min(left, queues[i][at][1])
                    left -= got
                    if got == queues[i][at][1]:
                        queues[i].pop(at)
                    else:
                        queues[i][at] = (length, queues[i][at][1] - got)
            runs.leave(capacity - offset, runs.next, n)
            runs.next += n
            times -= n
    for length in sorted((k for k in counts if k not in large), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(runs.rooms, length)
            if at < len(runs.rooms):
                room = runs.rooms[at]
                first, n = runs.take(room, left)
                runs.place(length, n, first, capacity - room)
                runs.leave(room - length, first, n)
                left -= n
            else:
                each = capacity // length
                n = left // each
                if n:
                    for k in range(each):
                        runs.place(length, n, runs.next, k * length)
                    runs.leave(capacity - each * length, runs.next, n)
                    runs.next += n
                    left -= n * each
                else:
                    for k in range(left):
                        runs.place(length, 1, runs.next, k * length)
                    runs.leave(capacity - left * length, runs.next, 1)
                    runs.next += 1
                    left = 0
    return runs.placed


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """The plan with the fewest sequences among a few settings of the grouping."""
    plans = [plan(dict(counts), capacity, groups, small) for small in (0.34, 0.5) for groups in (12, 24)]
    return min(plans, key=lambda runs: max((first + b - a for _, a, b, first, _ in runs), default=0))


def assign(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``; reads ``doc_id, piece, length`` (1 to capacity), keeps the rest.

    Pieces are ranked within (length, bucket of doc_id), and the buckets of a length start where the earlier
    ones end, so that one length may hold all pieces. ``pieces`` is read twice: stage it. Repeated rows are
    placed one by one; no rows give no rows.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    scratch = Scratch(spark, "packing")
    per = scratch.save(per, "counts")
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    runs = sorted(best_plan(counts, capacity))
    before = F.coalesce(
        F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    starts = per.select("length", "_bucket", before.alias("_before"))
    ranked = pieces.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1
    ).join(starts, ["length", "_bucket"])
    lo = np.array([(r[0] << 40) + r[1] for r in runs] or [0], np.int64)
    first, at = np.array([r[3] - r[1] for r in runs] or [0], np.int64), np.array([r[4] for r in runs] or [0], np.int64)
    held = spark.sparkContext.broadcast((lo, first, at))  # a few runs for each length

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, first, at = held.value
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("_rank")).to_numpy(zero_copy_only=False)
            run = np.searchsorted(lo, (length.astype(np.int64) << 40) + rank, "right") - 1
            keep = [i for i, x in enumerate(names) if x != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(first[run] + rank), pa.array(at[run])],
                [*(names[i] for i in keep), "sequence_id", "offset"],
            )

    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_before", "_bucket")
    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["sequence_id bigint", "offset bigint"])
    return ranked.mapInArrow(look_up, schema)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The staged pieces with their ids, and their places: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. The ids stay where they are; only narrow rows are ranked and shuffled."""
    pieces = Scratch(docs.sparkSession, "packing").save(tokenised(docs, vocabulary, capacity), "pieces")
    places = assign(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity)
    return pieces, places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, doc_ids, ids``: the sequences themselves, at most ``capacity`` ids each. doc_id must
    be unique here, as ids meet their places by (doc_id, piece)."""
    packed = pieces.select("doc_id", "piece", "ids").join(places, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most `capacity` pieces
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
        .select(
            "sequence_id",
            "n_tokens",
            F.col("p.doc_id").alias("doc_ids"),
            F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        )
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))[1]
