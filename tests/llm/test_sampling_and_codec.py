"""Importance resampling, divergence audit and the byte-pair codec against brute-force versions and the library."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.llm import bpe_codec, byte_words, divergence, importance
from marketloom.llm.common import Scratch
from marketloom.llm.tokens import load_tokenizer, vocabulary_path

LONG = " ".join(f"Wort{i % 97}" for i in range(30_000))
TEXTS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "The the THE cat cat. 7 dogs; Zażółć" + " é" * 30, "en", "b"), (4, LONG, None, "b"), (5, "a b c " * 10, "en", "a"),
    (5, "a b c " * 10, "en", "a"), (None, "ünder the <|endoftext|> cat" * 9, "de", "c"), (6, "x" * 5000 + " the cat" * 20, "de", "c"), (7, " \x00 \t0:@[`{~\x7f ", "fr", "z"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n int, term string, item string, score string, rank string, ids string, decoded string, cells string"
VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "t", "i", "s", "r", "x", "d", "c") for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 é日.\n" + "z" * 3, max_size=90), max_size=6))
def test_words_and_crc_of_bytes(texts):
    data, offsets = byte_words.text_bytes(pa.array(texts, pa.string()))
    starts, stops, doc = byte_words.word_bounds(data, offsets, importance.WORD_BYTES)
    lower = byte_words.LOWER[data]
    want = [(i, w.encode()) for i, t in enumerate(texts) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))]
    assert [(int(i), lower[a:b].tobytes()) for i, a, b in zip(doc, starts, stops, strict=True)] == want
    assert byte_words.crc_of(lower, starts, stops).tolist() == [zlib.crc32(w) for _, w in want]


def features(text, runs):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("runs", [1, 2])
def test_importance(spark, docs, empty, runs):
    goal = spark.createDataFrame([("the cat sat",), (None,), ("a the",)], "text string")
    of = lambda f: zlib.crc32(f.encode()) % 500
    s = collections.Counter(of(f) for r in TEXTS for f in features(r[1], runs)[1])
    t = collections.Counter(of(f) for x in ("the cat sat", None, "a the") for f in features(x, runs)[1])
    total = [sum(c.values()) + 500 for c in (s, t)]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * total[0] / ((s[b] + 1.0) * total[1])))
    rows = []
    for i, text, *_ in TEXTS:
        n, f = features(text, runs)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    got = importance.resample(docs, goal, runs, 500, percent=60).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(key, ((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got))) == sorted(map(key, rows))
    drawn = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert drawn == [(k + 1, r[0], r[4]) for k, r in enumerate(able[: 60 * len(able) // 100])]
    assert importance.resample(empty, goal).count() == 0
    assert importance.resample(docs, goal.limit(0), percent=100).filter("rank IS NOT NULL").count() == len(able)


def brute_audit(rows, least, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))) for _, text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in words}:
        own = [x for x in words if x[0] == lang]
        kept = [t for t, n in collections.Counter(t for *_, w in own for t in set(w)).items() if n >= least]
        count = collections.defaultdict(collections.Counter)
        for _, source, w in own:
            count[source].update(t for t in w if t in set(kept))
        total = sum(count.values(), collections.Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for g in count:
            pairs = [(sum(abs(share(count[g], t) - share(count[o], t)) for t in kept), o) for o in count if o != g]
            terms = [(share(count[g], t) - share(total, t), t) for t in kept if count[g][t] and share(count[g], t) > share(total, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, g, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)}
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_divergence(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(5)
    rows = list(TEXTS) + [(k, " ".join(rng.choices(["ab", "Cd", "é", "the", "cat", "x"], [9, 3, 2, 5, 1, 1], k=rng.randrange(12))), "en", rng.choice("abcdefg")) for k in range(60)]
    table = spark.createDataFrame([(*r, 1, "t", "i", "s", "r", "x", "d", "c") for r in rows], SCHEMA)
    got = [tuple(r) for r in divergence.audit(table, 2, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 2, 3)
    assert divergence.audit(empty).count() == 0


def test_divergence_flushes_within_bounds(monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 8)
    counter = divergence.TermCounter()
    counter.add(pa.array(["a b c d e", "a a b"]), ["x", "x"], ["s", "t"])
    assert counter.full()
    rows = counter.batch().to_pylist()
    assert {(r["source"], r["term"]): (r["n"], r["docs"]) for r in rows} == {("s", t): (1, 1) for t in "abcde"} | {("t", "a"): (2, 1), ("t", "b"): (1, 1)}


@pytest.fixture(scope="module")
def codec():
    path = vocabulary_path(VOCABULARY)
    return bpe_codec.BacktrackingEncoder(path, max_pieces=64), load_tokenizer(path)


FRAGMENTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\r\n", "é", "日本", "　", "'s", "'RE", "12", "!?", "<|endoftext|>", "<|end", "\x01", "🙂", "aaaa"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(FRAGMENTS), max_size=25).map("".join), min_size=1, max_size=6))
def test_codec_equals_the_library(codec, texts):
    own, library = codec
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    offsets = np.cumsum([0, *map(len, ids)])
    assert bpe_codec.decoded(*own.rules.decode_bytes(np.concatenate(ids).astype(np.int64), offsets)).to_pylist() == texts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=12))
def test_decoding_any_ids(codec, ids):
    own, library = codec
    got = bpe_codec.decoded(*own.rules.decode_bytes(np.array([*ids, 70_000, -1], np.int64), np.array([0, len(ids) + 2])))
    assert got.to_pylist() == [library.decode(ids, skip_special_tokens=False)]


def test_pairs_are_compatible_as_the_library_merges(codec):
    own, library = codec
    rules, rng = own.rules, random.Random(2)
    plain = [t for t in rules.id_of_text if t.isascii() and t.isalpha()]
    a, b = (rng.choices(plain, k=4000) for _ in range(2))
    ids = np.array([[rules.id_of_text[x], rules.id_of_text[y]] for x, y in zip(a, b, strict=True)])
    want = [library.encode(x + y, add_special_tokens=False).ids == pair for x, y, pair in zip(a, b, ids.tolist(), strict=True)]
    for _ in range(2):  # computed, then from the table
        assert rules.compatible(ids[:, 0], ids[:, 1]).tolist() == want


def test_codec_tables(spark, docs, empty):
    library = load_tokenizer(vocabulary_path(VOCABULARY))
    encoded = bpe_codec.encode(docs, VOCABULARY)
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, *_ in TEXTS)
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe_codec.decode(encoded, VOCABULARY).collect()) == want
    both = bpe_codec.encode(docs, VOCABULARY, read_back=True).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in both) == want
    assert bpe_codec.encode(empty, VOCABULARY, read_back=True).count() == 0
    assert bpe_codec.decode(encoded.limit(0), VOCABULARY).count() == 0


def test_codec_query(spark):
    library = load_tokenizer(vocabulary_path(VOCABULARY))
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in texts:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in bpe_codec.op13_bpe_codec(spark, "/root/testdata/sf0.001").collect()} == want


def test_long_and_repeated_letters(codec):
    own, library = codec
    for text in ("a" * 20_000, "ab" * 7_000 + "é" * 3_000, "=" * 9_001, " " * 3_000 + "x"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_runs_do_not_cross_texts():
    n_words, indptr, indices, counts = importance.bucket_counts(pa.array(["a b", "c", "", "d e f"]), 2, 10_000)
    assert n_words.tolist() == [2, 1, 0, 3] and np.diff(indptr).tolist() == [3, 1, 0, 5]
    rows = [set(indices[a:b].tolist()) for a, b in itertools.pairwise(indptr.tolist())]
    assert rows[0] == {zlib.crc32(x) % 10_000 for x in (b"a", b"b", b"a b")} and counts.sum() == 9


def test_blocks_of_a_matrix_are_small(spark):
    """A reader decodes many blocks at once, so none may hold the cells of megabytes of text."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(4000)), lambda x: F.concat(F.lit("w"), (x * 7919 + F.col("id") * 31).cast("string"))))
    docs = spark.range(0, 900, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"))
    scratch = Scratch(spark, "blocks")
    matrix = scratch.save(importance.count_matrix(docs), "matrix", **importance.ROW_GROUP)
    assert matrix.agg(F.sum(F.size("doc_id")), F.max(F.size("indices")) < 100_000).first() == (900, True)
