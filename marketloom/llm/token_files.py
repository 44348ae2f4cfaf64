"""Token-id shards with a minimal perfect hash index.

Documents lie in ascending doc_id order in shard files: raw ids (uint16 where the vocabulary allows, else
uint32), then a directory of doc_ids and offsets, then the index. The index is a minimal perfect hash over the
shard's doc_ids: levels of bit arrays in which a key claims the bit its hash names, keys that collide go to the
next level, and the rank of a key's bit is its slot. A slot stores a fingerprint of its key and the document's
place in the directory, so a lookup reads one slot, checks the fingerprint and knows the payload's bytes,
whatever the size of the shard; unknown keys are refused.

Files are written under the shared folder through a temporary name and renamed when whole, so a task that runs
again replaces its own files and no reader sees half a file. Only rows about shards come back to the driver's
manifest table.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, shared_dir, table
from marketloom.llm.tokens import arrow_blocks, encoder, vocabulary_path

#: Fixed values of the file format.
MAGIC = b"TOKSHRD2"
HEADER = struct.Struct("<8sIIQQQQQQ")  # magic, bytes an id, levels, documents, keys, ids; directory, index, slots at
LEVEL = struct.Struct("<QQ")  # bits of a level, how many are set
#: Bits of a block; each block's count of set bits before it is stored.
BLOCK = 512
END_ID = 0
#: Bits for each key in a level, and the most levels before keys are listed one by one.
GAMMA, LEVELS = 2, 40


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of integer keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct int64 keys to 0..n-1."""

    def __init__(self, bits: list[np.ndarray]) -> None:
        self.bits = bits
        self.before = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self.rank = [np.concatenate([[0], np.cumsum(b)]) for b in bits]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, left = [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, GAMMA * len(left))
            at = (mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys must be distinct")
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a foreign key gets some slot or -1, which its fingerprint must refuse."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            at = (mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.rank[level][at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 977) >> np.uint64(32)).astype(np.uint32)


def level_bytes(bits: np.ndarray) -> bytes:
    """A level: its bits in blocks, then the number of set bits before each block."""
    blocks = -(-len(bits) // BLOCK)
    padded = np.zeros(blocks * BLOCK, bool)
    padded[: len(bits)] = bits
    counts = padded.reshape(-1, BLOCK).sum(1)
    before = (np.cumsum(counts) - counts).astype("<u8")
    return LEVEL.pack(len(bits), int(counts.sum())) + np.packbits(padded).tobytes() + before.tobytes()


def shard_bytes(keys: np.ndarray, present: np.ndarray, lengths: np.ndarray, payload: np.ndarray) -> bytes:
    """A shard file. ``present`` is false for a null doc_id; of equal doc_ids the first is the one indexed."""
    starts = np.cumsum(lengths) - lengths
    _, first = np.unique(keys[present], return_index=True)
    rows = np.flatnonzero(present)[np.sort(first)]
    index = PerfectHash.build(keys[rows])
    slots = np.zeros(len(rows), [("fp", "<u4"), ("row", "<u4")])
    at = index.slots(keys[rows])
    slots["fp"][at], slots["row"][at] = fingerprints(keys[rows]), rows
    raw = payload.tobytes()
    directory = b"".join(
        [keys.astype("<i8").tobytes(), present.astype("u1").tobytes(), starts.astype("<u8").tobytes(), lengths.astype("<u8").tobytes()]
    )
    bits = b"".join(map(level_bytes, index.bits))
    at_dir = HEADER.size + len(raw)
    at_index = at_dir + len(directory)
    head = HEADER.pack(
        MAGIC, payload.dtype.itemsize, len(index.bits), len(keys), len(rows), len(payload), at_dir, at_index, at_index + len(bits)
    )
    return b"".join([head, raw, directory, bits, slots.tobytes()])


class Shard:
    """A shard file opened for reading. Opening reads the header; ``get`` reads a few bytes a level, one slot, one
    directory row and the ids, whatever the size of the shard."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        head = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        magic, self.width, self.levels, self.n, self.n_keys, self.n_ids, self.at_dir, self.at_index, self.at_slots = head
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")

    def _number(self, at: int, kind: str = "<Q") -> int:
        return struct.unpack(kind, self.file.read_at(8, at))[0]

    def slot(self, key: int) -> int:
        """The slot of one key, or -1, by one block in each level until its bit is set."""
        at, base = self.at_index, 0
        for level in range(self.levels):
            size, ones = LEVEL.unpack(self.file.read_at(LEVEL.size, at))
            blocks = -(-size // BLOCK)
            place = int(mixed(np.array([key], np.int64), level)[0] % np.uint64(size))
            block, bit = divmod(place, BLOCK)
            bits = np.unpackbits(np.frombuffer(self.file.read_at(BLOCK // 8, at + LEVEL.size + block * (BLOCK // 8)), np.uint8))
            if bits[bit]:
                return base + self._number(at + LEVEL.size + blocks * (BLOCK // 8) + 8 * block) + int(bits[:bit].sum())
            at, base = at + LEVEL.size + blocks * (BLOCK // 8 + 8), base + ones
        return -1

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document by its key, or None."""
        at = self.slot(key)
        if at < 0:
            return None
        mark, row = struct.unpack("<II", self.file.read_at(8, self.at_slots + 8 * at))
        if mark != fingerprints(np.array([key], np.int64))[0] or self._number(self.at_dir + 8 * row, "<q") != key:
            return None
        start = self._number(self.at_dir + 9 * self.n + 8 * row)
        length = self._number(self.at_dir + 17 * self.n + 8 * row)
        return self.payload(start, length)

    def payload(self, start: int, length: int) -> np.ndarray:
        data = self.file.read_at(self.width * int(length), HEADER.size + self.width * int(start))
        return np.frombuffer(data, f"<u{self.width}")

    def directory(self) -> ShardDirectory:
        return ShardDirectory(self)


class ShardDirectory:
    """The whole directory and index of a shard, for reading all of it."""

    def __init__(self, shard: Shard) -> None:
        n, at = shard.n, shard.at_index - shard.at_dir
        rest = shard.file.read_at(shard.at_slots - shard.at_dir + 8 * shard.n_keys, shard.at_dir)
        self.keys = np.frombuffer(rest, "<i8", n)
        self.present = np.frombuffer(rest, "u1", n, 8 * n).astype(bool)
        self.starts = np.frombuffer(rest, "<u8", n, 9 * n).astype(np.int64)
        self.lengths = np.frombuffer(rest, "<u8", n, 17 * n).astype(np.int64)
        bits = []
        for _ in range(shard.levels):
            size, _ = LEVEL.unpack_from(rest, at)
            blocks = -(-size // BLOCK)
            packed = np.frombuffer(rest, "u1", blocks * (BLOCK // 8), at + LEVEL.size)
            bits.append(np.unpackbits(packed, count=size).astype(bool))
            at += LEVEL.size + blocks * (BLOCK // 8 + 8)
        self.index = PerfectHash(bits)
        self.slots = np.frombuffer(rest, [("fp", "<u4"), ("row", "<u4")], shard.n_keys, at)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The directory rows of keys, -1 for keys that the shard lacks."""
        keys = np.asarray(keys, np.int64)
        at = self.index.slots(keys)
        known = at >= 0
        known[known] = self.slots["fp"][at[known]] == fingerprints(keys[known])
        out = np.full(len(keys), -1, np.int64)
        out[known] = self.slots["row"][at[known]]
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out


MANIFEST = "part int, shard int, uri string, min_id bigint, max_id bigint, documents bigint, ids bigint"


def write_shards(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", uri: str | None = None, shard_ids: int = 16_000_000, docs_per_part: int = 50_000) -> DataFrame:
    """Write ``docs`` and return the manifest: one row per shard file, with the number of ids ``before`` it.

    Parts are ranges of doc_id with about as many documents each, found from doc_id alone; a part's task gets
    ids, not texts, sorted, and starts a new file after ``shard_ids`` ids, so that neither memory nor files
    grow with the part. Null texts count as empty; null doc_ids come first and are not indexed; documents of
    one doc_id follow one another in the order of their ids. An empty table gives no shard. The driver holds one
    summary of doc_id quantiles, of max(10,000, 20 * parts) entries, and as many edges as parts.
    """
    spark = docs.sparkSession
    path = vocabulary_path(vocabulary)
    uri = uri or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex[:12]}"
    uri = uri if "://" in uri else "file://" + uri.removeprefix("file:")
    n = docs.select("doc_id").count()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // docs_per_part)) if n else 1
    cuts = [k / parts for k in range(1, parts)] or [0.5]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * parts)).alias("b")).first()["b"] or [0]
    edges = np.unique(np.array(bounds if parts > 1 else [2**63 - 1], np.int64))
    dtype = "<u2" if encoder(path).tok.get_vocab_size() <= 2**16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path).encode
        for batch in batches:
            part = np.searchsorted(edges, batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False), "left")
            for a, texts in arrow_blocks(batch, 1):
                data = [np.append(x, np.uint32(END_ID)).astype(dtype).tobytes() for x in to_ids(texts)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[a : a + n], pa.int32()), batch.column(0).slice(a, n), pa.array(data, pa.binary())],
                    ["part", "doc_id", "ids"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        held: list[bytes] = []
        part, shard, size, width = -1, 0, 0, np.dtype(dtype).itemsize
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root)

        def flush() -> list[pa.RecordBatch]:
            if not keys:
                return []
            present = np.array([k is not None for k in keys])
            own = np.array([0 if k is None else k for k in keys], np.int64)
            payload = np.frombuffer(b"".join(held), dtype)
            lengths = np.fromiter(map(len, held), np.int64, len(held)) // payload.dtype.itemsize
            name = f"{root}/part-{part:06d}-{shard:04d}.tok"
            own_name = f"{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own_name) as out:
                out.write(shard_bytes(own, present, lengths, payload))
            fs.move(own_name, name)
            place = uri.rstrip("/") + name.removeprefix(root)
            ids = [k for k in keys if k is not None] or [None]
            row = [part, shard, place, ids[0], ids[-1], len(keys), len(payload)]
            types = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            keys.clear(), held.clear()
            return [pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)],
                    ["part", "shard", "uri", "min_id", "max_id", "documents", "ids"])]

        for batch in batches:
            for p, key, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part or size >= shard_ids:
                    yield from flush()
                    shard, size, part = (0 if p != part else shard + 1), 0, p
                keys.append(key)
                held.append(ids)
                size += len(ids) // width
        yield from flush()

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    ids = docs.select("doc_id", text).mapInArrow(encode, "part int, doc_id bigint, ids binary")
    rows = ids.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    manifest = Scratch(spark, "token-files").save(rows.mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, found through the index: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``ids`` are uint32 little-endian bytes. Rows of a doc_id that the index does not name (nulls, repeats) are
    read by the directory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                own = shard.directory()
                found = np.arange(shard.n)
                first = own.present.copy()
                first[1:] &= (own.keys[1:] != own.keys[:-1]) | ~own.present[:-1]
                found[first] = own.rows(own.keys[first])
                for a in range(0, shard.n, 1000):
                    rows = found[a : a + 1000]
                    data = [shard.payload(own.starts[r], own.lengths[r]).astype("<u4").tobytes() for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.keys[rows], pa.int64(), mask=~own.present[rows]), pa.array(before + own.starts[rows], pa.int64()),
                         pa.array(own.lengths[rows], pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(data, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        manifest.select("uri", "before")
        .repartition(tasks)
        .mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    )


def look_up(keys: DataFrame, manifest: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``doc_id, ids`` for each doc_id asked for; ids is null for unknown ones and for null.

    Shards follow one another by doc_id: a key's shard is found by bisection in the shards' bounds, ``most`` of which
    are sent to each task at most; keys then meet in tasks by shard. Of several documents of one doc_id the first
    is returned.
    """
    rows = manifest.filter("max_id IS NOT NULL").orderBy("part", "shard").select("uri", "min_id", "max_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} shards are too many to send to each task; write larger shards")
    bounds = np.array([(r["min_id"], r["max_id"]) for r in rows], np.int64).reshape(-1, 2)
    held = keys.sparkSession.sparkContext.broadcast((bounds, [r["uri"] for r in rows]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, _ = held.value
        for batch in batches:
            own = batch.column(0)
            ids = own.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds[:, 1], ids, "left")
            known = at < len(bounds)
            known[known] = bounds[at[known], 0] <= ids[known]
            known &= own.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([own, pa.array(np.where(known, at, -1), pa.int64())], ["doc_id", "shard"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = -1, None
        for batch in batches:
            ids = []
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != now:
                    now, shard = own, Shard(held.value[1][own]) if own >= 0 else None
                got = shard.get(key) if shard else None
                ids.append(None if got is None else got.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    placed = keys.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(place, "doc_id bigint, shard bigint")
    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(fetch, "doc_id bigint, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"))).drop("ids")
