"""Each operator against a brute-force version, on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import chat_format, exact_dedup, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules
from marketloom.llm import token_counts, token_files, tokens
from marketloom.llm.queries import ORACLES, QUERIES
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(9000))
TEXTS = [
    (0, "Released under the MIT License."), (1, None), (2, ""), (3, " \t\n "), (4, "a  b"), (5, "a b"), (6, "a b"), (7, LONG), (8, LONG + " x"),
    (9, "one two three four five six seven eight " * 6), (10, "x $$$ y"), (11, "line\nline\nother\nline"), (12, "Zażółć 日本 <|endoftext|> 　 e\r\n"), (12, "Zażółć 日本 <|endoftext|> 　 e\r\n"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n int, size string, key string, id string, digest string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a"][k % 3], 1, "s", "k", "i", "d", "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_oracles(spark):
    for name, sql in ORACLES.items():
        assert differences(spark, QUERIES[name], sql, SF) == ""


def test_exact_dedup(spark, docs, empty, tmp_path):
    want = collections.defaultdict(list)
    for i, t in TEXTS:
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    by_id = {i: (min(v), len(v)) for v in want.values() for i in v}
    got = exact_dedup.dedup(docs).collect()
    assert len(got) == len(TEXTS) and all((r.keep_id, r.group_size) == by_id[r.doc_id] for r in got)
    index = f"file://{tmp_path}/index"
    exact_dedup.dedup(docs.filter("doc_id < 5"), index).count()
    later = {r.doc_id: r.keep_id for r in exact_dedup.dedup(docs.filter("doc_id >= 5"), index).collect()}
    assert later[5] == 4 and later[6] == 4 and later[7] == 7  # "a  b" came with the earlier batch
    assert exact_dedup.keep_first(docs).count() == len(want)
    assert exact_dedup.dedup(empty).count() == 0


def test_quality_measures(spark, docs, empty):
    for r in quality_rules.measures(docs).collect():
        w = words(r.text)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
    labels = spark.createDataFrame([(1, 1), (7, 1), (7, 0), (None, 1)], "doc_id bigint, quality int")
    assert quality_rules.judge(docs, labels).count() == len(TEXTS)
    assert quality_rules.judge(empty, labels.limit(0)).count() == 0


def test_binomial_tail(spark):
    from math import comb

    rows = [(k, n) for n in (1, 7, 60) for k in range(n + 1)]
    df = spark.createDataFrame(rows, "k bigint, n bigint")
    for r in df.withColumn("p", quality_rules.binomial_tail(df.k, df.n, 0.1)).collect():
        exact = sum(comb(r.n, i) * 0.1**i * 0.9 ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - exact) < 1e-9


def test_cutoffs_and_verdicts(spark):
    """Cutoffs and verdicts against a plain reading of the method: a large stratum, two small ones that are pooled."""
    from math import comb, log

    rng = random.Random(8)
    limits = quality_rules.RiskLimits(alpha=0.2, delta=0.2)
    rows, good = [], []
    for i in range(900):
        lang = "a" if i < 600 else "b" if i < 750 else None
        w = [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(21, 60))]
        for _ in range(rng.choice([0, 0, 0, 0, 1, 2, 5, 9, 30])):
            w.append("$" * rng.randrange(1, 4))
        text = " ".join(w[:10]) + "\n" + " ".join(w[10:])
        text += "\nsame line" * rng.choice([0] * 20 + [1, 3])
        rows.append((i, text, lang))
        if rng.random() < 0.8:
            good.append((i, 1))
    rows += [(5000, None, "a"), (5001, "short", "b"), (5002, rows[0][1] + " $$$" * 90, "c")]
    labels = spark.createDataFrame([*good, (1, 0), (5001, 1)], "doc_id bigint, quality int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels, limits).collect()}

    def measured(r, text):
        lines = [x for x in (text or "").split("\n") if words(x)]
        n = max(1, r.n_words)
        return {"symbols_per_word": 1000 * r.n_symbols // n, "dup_line_share": 1000 * r.n_dup_lines // max(1, len(lines)), "repeat_share": 1000 * r.n_repeat_words // n, "long_words": 100 * r.word_chars // n}

    marked, values, strata = {i for i, _ in good}, {}, collections.defaultdict(list)
    for i, text, lang in rows:
        values[i] = measured(got[i], text)
        if i in marked and not got[i].base_failed:
            strata[lang].append(i)
    alpha, level = 0.2 / 4, 0.2 / 4 / 4  # four rules; three strata and the pool
    need = next(n for n in range(1, 10**6) if n * log(1 - alpha) <= log(level))
    own = {x: ids for x, ids in strata.items() if len(ids) >= need}
    assert set(own) == {"a", "b", None}
    small = spark.createDataFrame([(i, t, f"{x}{i % 3}") for i, t, x in rows], "doc_id bigint, text string, lang string")
    for table, groups in ((docs, own), (small, None)):
        got = {r.doc_id: r for r in quality_rules.judge(table, labels, limits).collect()}
        if groups is None:  # 9 strata of which those of "b" and null are too small
            by = collections.defaultdict(list)
            level = 0.2 / 10 / 4
            need = next(n for n in range(1, 10**6) if n * log(1 - alpha) <= log(level))
            for x, ids in strata.items():
                for i in ids:
                    by[f"{x}{i % 3}"].append(i)
            groups = {x: ids for x, ids in by.items() if len(ids) >= need}
            groups["pool"] = [i for x, ids in by.items() if len(ids) < need for i in ids]
            assert 3 <= len(groups) <= 4 and groups["pool"]
        cutoffs = {}
        for x, ids in groups.items():
            for rule, cuts in quality_rules.CUTOFFS.items():
                for cut in cuts:
                    lost = sum(values[i][rule] > cut for i in ids)
                    n = len(ids)
                    if sum(comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(lost + 1)) > level:
                        break
                    cutoffs[x, rule] = cut
        assert cutoffs
        rejected = 0
        for i, _, lang in rows:
            x = lang if table is docs else f"{lang}{i % 3}"
            x = x if x in groups else "pool"
            fails = [rule for rule in quality_rules.CUTOFFS if values[i][rule] > cutoffs.get((x, rule), 10**9)]
            assert got[i].kept == (not got[i].base_failed and not fails)
            rejected += bool(fails)
        assert rejected


def test_near_dedup(spark, docs, empty):
    o = near_dedup.NearOptions(shingle=3, similarity=85)
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, t) for i, t in TEXTS]
    for k in range(60):
        own = list(base)
        for _ in range(k // 6):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(own)))
    sets = []
    for _, t in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)]))
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for (i, _), a in zip(rows, sets, strict=True):
            for (j, _), b in zip(rows, sets, strict=True):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), o).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), comp[i]) for (i, _), s in zip(rows, sets, strict=True)}
    assert near_dedup.near_groups(docs, o).count() == len(TEXTS)
    assert near_dedup.near_groups(empty, o).count() == 0


def test_joint_similarity():
    rng = np.random.default_rng(1)
    for true in (0.5, 0.85, 0.95):
        n = 1000
        k = int(2 * n * true / (1 + true))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:k], pool[n : 2 * n - k]])
        s = near_dedup.sketches([a, b, np.union1d(a, b)], 1024)
        got = near_dedup.joint_similarity(s[:1], s[1:2], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(got - true) < 0.06
        assert (near_dedup.merge(s[0], s[1]) == s[2]).all()


def library():
    return tokens.load_tokenizer(tokens.vocabulary_path("byte_bpe_50k.json"))


PARTS = [" ", "  ", "\n", "\t", "a", "é", "1", "!", "'s", "　", "\x85", "\x1c", "<|endoftext|>", "日", "The", "don't", "\r", ".", ",\"", "\x01", " \x01\n", "ñ.", "...", "\u0301", "²"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=5))
def test_tokens_equal_library(texts):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    want = [e.ids for e in tokens.encoder(path).tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.encoder(path).encode(texts)] == want
    assert token_counts.counter(path).count(texts).tolist() == list(map(len, want))


def test_small_tables_of_pieces():
    """Tables that overflow at every batch give the library's ids and counts all the same."""
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    rng = random.Random(9)
    encode = tokens.PieceEncoder(path, 60)
    count = token_counts.TokenCounter(path, token_counts.whole_tokens(encode.tok), 60)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "river", f"x{rng.randrange(500)}", "end.\nNew", "", "a,b", "ß!"]) for _ in range(rng.randrange(60))) for _ in range(8)]
        want = [e.ids for e in encode.tok.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encode.encode(texts)] == want and count.count(texts).tolist() == list(map(len, want))
    assert len(encode.slot) < 600 and len(count.slot) < 600


def test_counts_packing_and_files(spark, docs, empty):
    ids = {i: library().encode(t or "", add_special_tokens=False).ids for i, t in TEXTS}
    assert all(r.n_tokens == len(ids[r.doc_id]) for r in token_counts.count_tokens(docs).collect())
    pieces, places = packing.pack(docs)
    rows = places.collect()
    assert sum(r.length for r in rows) == sum(len(ids[i]) + 1 for i, _ in TEXTS)
    for r in rows:
        part = ([*ids[r.doc_id], 0])[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(empty)[1].count() == 0
    manifest = token_files.write_shards(docs, docs_per_part=4, shard_ids=2000)
    back = sorted(token_files.read_shards(manifest).collect(), key=lambda r: r.start)
    end = 0
    for r, (i, _) in zip(back, sorted(TEXTS, key=lambda x: x[0]), strict=True):
        assert (r.doc_id, r.start) == (i, end)
        assert np.frombuffer(r.ids, "<u4").tolist() == [*ids[i], 0]
        end += r.n_tokens
    keys = spark.createDataFrame([(7,), (12,), (77,)], "doc_id bigint")
    found = {r.doc_id: r.ids for r in token_files.look_up(keys, manifest).collect()}
    assert np.frombuffer(found[7], "<u4").tolist() == [*ids[7], 0] and found[77] is None
    assert token_files.read_shards(token_files.write_shards(empty)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 40), max_size=60))
def test_plan_places_everything(counts):
    runs = packing.best_plan(counts)
    fill, ranks = collections.Counter(), collections.defaultdict(list)
    for length, a, b, first, offset in runs:
        ranks[length] += range(a, b)
        for k in range(b - a):
            fill[first + k] += length
            assert offset + length <= 2048
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert all(v <= 2048 for v in fill.values())


def test_keyed_access(spark, tmp_path):
    """Every key by single reads, over shards of uint32 and uint16 ids; a doc_id in several shards comes once."""
    rng = np.random.default_rng(4)
    for kind in ("<u2", "<u4"):
        keys = np.sort(rng.choice(10**9, 3000, replace=False)) - 10**8
        lengths = rng.integers(0, 20, len(keys))
        payload = rng.integers(0, 60000, lengths.sum()).astype(kind)
        path = tmp_path / f"shard{kind[1:]}"
        path.write_bytes(token_files.shard_bytes(keys, np.ones(len(keys), bool), lengths, payload))
        shard = token_files.Shard(f"file://{path}")
        ends = np.cumsum(lengths)
        for k in range(0, len(keys), 7):
            assert shard.get(int(keys[k])).tolist() == payload[ends[k] - lengths[k] : ends[k]].tolist()
        assert all(shard.get(int(k)) is None for k in rng.integers(2 * 10**9, 3 * 10**9, 300))
        assert (shard.directory().rows(keys) == np.arange(len(keys))).all()
    docs = spark.createDataFrame([(i % 40, f"text {i} " * (i % 5)) for i in range(200)], "doc_id bigint, text string")
    manifest = token_files.write_shards(docs, docs_per_part=50, shard_ids=20)
    assert manifest.count() > 20
    asked = spark.createDataFrame([(i,) for i in [*range(-3, 45), None]], "doc_id bigint")
    got = token_files.look_up(asked, manifest).collect()
    assert len(got) == 49 and {r.doc_id for r in got if r.ids is not None} == set(range(40))
    stored = collections.defaultdict(set)
    for r in token_files.read_shards(manifest).collect():
        stored[r.doc_id].add(bytes(r.ids))
    assert all(r.ids is None or bytes(r.ids) in stored[r.doc_id] for r in got)


def test_training_sample(spark):
    rows = [(i, "good words here " * 3) for i in range(1, 40)] + [(3, "other"), (5, "x" * 3000), (7, None), (9, "y"), (9, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 45)] + [(4, None)], "doc_id bigint, quality int")
    seen = []
    real, quality_classifier.fit = quality_classifier.fit, lambda texts, marks: seen.append((texts, marks))
    try:
        quality_classifier.train(docs, labels)
        quality_classifier.train(docs, labels, max_rows=10)
        quality_classifier.train(docs, labels, max_chars=400)
        quality_classifier.train(docs, labels.limit(0))
    finally:
        quality_classifier.fit = real
    fold = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    assert len(seen[0][0]) == len(fold) and len(seen[1][0]) <= 10 and not len(seen[3][0])
    assert 0 < sum(map(len, seen[2][0])) <= 400 and all(len(t) <= 10 for t in seen[2][0])
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    model = quality_classifier.fit([], np.zeros(0))
    assert quality_classifier.classify(empty, model).count() == 0 and token_counts.count_tokens(empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 20000))
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))


def test_mixing(spark, docs, empty):
    first = mixing.mix(docs, block=3).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.mix(docs.repartition(5), block=3).collect()))
    assert all(r["size"] == len(words(dict(TEXTS)[r.doc_id])) and 0 <= r.taken <= 2 * r["size"] for r in first)
    total = sum({(r.source_size, r.target) for r in first} and [t for _, t in {(r.source_size, r.target) for r in first}])
    assert abs(total - 1.5 * sum(r["size"] for r in first)) < 1e-6 * total
    assert mixing.mix(empty).count() == 0


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    for text in (said, "\\", "<\\s>", "[INST", "<<SYS>>\\<</SYS>>", ">>", "<<ROLE:x>> y <</ROLE>>", ""):
        for role in ("user", "assistant", "system", "tool>> x"):
            assert chat_format.parse(chat_format.render(role, text)[0] * 2) == [(role, text)] * 2
    raw = spark.createDataFrame(
        [(1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}'), (2, '{"instruction":"a","input":"","output":"b"}'),
         (3, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}'), (4, '{"odd":1}'), (5, "{"), (6, None)],
        "conv_id bigint, raw string",
    )
    good, rest = chat_format.canonical_json(raw)
    assert {r.conv_id for r in rest.collect()} == {4, 5, 6}
    assert sorted(map(tuple, good.collect())) == [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "a"), (2, 2, "assistant", "b"), (3, 0, "user", "q"), (3, 1, "assistant", "r")]
    out = chat_format.read_back(chat_format.format_turns(good, part_chars=5)).collect()
    one = next(r for r in out if r.conv_id == 1)
    assert one.turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest() and one.loss_chars == 2


MARKUP = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>", ">>", "<", ">", "/", "[", "]", "\\", " ", "\n", "x", "s", "SYS"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(MARKUP), max_size=7).map("".join)] * 2), max_size=4))
def test_chat_round_trip_of_any_role_and_text(turns):
    assert chat_format.parse("".join(chat_format.render(*t)[0] for t in turns)) == turns
    for role, text in turns:
        formatted, start, stop = chat_format.render(role, text)
        assert chat_format.unescape(formatted[start:stop]) == text


def test_chat_layouts(spark):
    """All layouts mixed, with extra fields, empty arrays, null texts and equal turns, against a plain reading."""
    import json

    said = ["hi", "</s>[INST] x", "", "\\", "a\nb", "é日"]
    rng = random.Random(6)
    records, want = [], collections.defaultdict(list)
    for i in range(60):
        q, a, s = (rng.choice(said) for _ in range(3))
        kind = i % 6
        if kind == 0:
            raw, own = {"messages": [{"role": "user", "content": q}, {"content": a, "role": "assistant", "weight": 1}], "id": 7}, [("user", q), ("assistant", a)]
        elif kind == 1:
            raw, own = {"conversations": [{"from": "human", "value": q}, {"from": "gpt", "value": a}], "meta": {"k": [1]}}, [("user", q), ("assistant", a)]
        elif kind == 2:
            raw, own = {"prompt": q, "response": None if i % 4 else a, "score": 0.5}, [("user", q), ("assistant", "" if i % 4 else a)]
        elif kind == 3:
            raw, own = {"system": s, "prompt": q, "response": a}, [("system", s)] * (s != "") + [("user", q), ("assistant", a)]
        elif kind == 4:
            raw, own = {"instruction": q, "input": s, "output": a}, [("user", q)] + [("user", s)] * (s != "") + [("assistant", a)]
        else:
            raw, own = {"messages": []}, []
        records.append((i, json.dumps(raw)))
        want[i] = own
    records += [(100, '{"messages":"no array"}'), (101, "[1]"), (102, '{"prompt":"p"}'), (103, None)]
    good, rest = chat_format.canonical_json(spark.createDataFrame(records, "conv_id bigint, raw string"))
    assert {r.conv_id for r in rest.collect()} == {100, 101, 102, 103}
    rows = spark.createDataFrame(
        [(200, 1, None, None, "x"), (200, 0, "tool", "t", "x"), (200, 1, None, None, "x"), (None, 0, "assistant", "n", "x")],
        "conv_id bigint, turn int, role string, text string, extra string",
    )
    want[200], want[None] = [("tool", "t"), ("user", ""), ("user", "")], [("assistant", "n")]
    pairs = spark.createDataFrame([(300, "q", "r", 1.0)], "conv_id bigint, question string, answer string, messages_seen double")
    want[300] = [("user", "q"), ("assistant", "r")]
    turns = good.unionByName(chat_format.canonical(rows)).unionByName(chat_format.canonical(pairs))
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns, part_chars=30)).collect()}
    assert set(out) == {k for k, v in want.items() if v}
    for k, r in out.items():
        loss = "".join(t for role, t in want[k] if role == "assistant")
        assert r.n_turns == len(want[k]) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[k]).encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat_format.render(*x)[0]) for x in want[k])
    for name in ("prompt", "system", "input", "output", "answer", "messages", "lang"):
        clash = rows.withColumn(name, rows.text)
        assert sorted(map(str, chat_format.canonical(clash).collect())) == sorted(map(str, chat_format.canonical(rows).collect()))
    assert chat_format.canonical(pairs.withColumn("prompt", pairs.question)).collect() == chat_format.canonical(pairs).collect()
    with pytest.raises(ValueError):
        chat_format.canonical(pairs.drop("answer"))
    assert chat_format.read_back(chat_format.format_turns(chat_format.canonical(rows.limit(0)))).count() == 0


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = collections.defaultdict(list)
    for r in rows:
        want[r.conv_id].append((r.role or "user", r.text or ""))
    want[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in QUERIES["op2_chat_format"](spark, SF).collect()}
    assert set(got) == set(want)
    for k, own in want.items():
        assert got[k].n_turns == len(own)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[k].loss_chars == len(loss)
        assert got[k].formatted_chars == sum(len(chat_format.render(*t)[0]) for t in own)


def test_factorisation_machine(spark, docs):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["river", "stone", "walks", "green"]) for _ in range(30)) for _ in range(150)]
    bad = [" ".join(rng.choice(["river$$$", "STONE!!", "walks&&&", "|"]) for _ in range(30)) for _ in range(150)]
    model = quality_classifier.fit(good[:100] + bad[:100], np.array([1.0] * 100 + [0.0] * 100))
    assert (model.score(good[100:]) > 0.5).mean() > 0.95 and (model.score(bad[100:]) < 0.5).mean() > 0.95
    rows, cols, vals = quality_classifier.features(good[:3])
    margin, _ = model.margin(rows, cols, vals, 3)
    for k in range(3):  # the linear form against the sum over pairs
        i, x = cols[rows == k], vals[rows == k]
        pairs = sum(model.v[i[a]] @ model.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(margin[k] - (model.bias + model.w[i] @ x + pairs)) < 1e-8
    assert quality_classifier.classify(docs, model).count() == len(TEXTS)


def test_license_scan(docs, empty):
    got = {r.doc_id: r.license for r in license_scan.scan(docs).collect()}
    assert got[0] == "MIT" and got[1] is None and got[7] is None
    assert license_scan.scan(empty).count() == 0


def test_sentence_pieces(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path("piece_bpe_32k.model"))
    want = {i: len(model.encode(t or "")) for i, t in TEXTS}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, "piece_bpe_32k.model").collect()} == want


def test_near_recall(spark):
    """Every pair at the limit or above, over a whole table, against all pairs of sets: one document of each class."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        s = near_dedup.shingle_set(r.text or "", 3)
        if len(s):
            sets.setdefault(s.tobytes(), []).append(r.doc_id)
    classes = [(min(ids), frozenset(np.frombuffer(k, np.uint64).tolist())) for k, ids in sets.items()]
    parent = {r.doc_id: r.doc_id for r in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for ids in sets.values():
        for i in ids:
            parent[i] = min(ids)
    links = 0
    for k, (i, a) in enumerate(classes):
        for j, b in classes[:k]:
            if 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
                links += 1
    got = {r.doc_id: r.component_id for r in QUERIES["op4_near_dedup"](spark, SF).collect()}
    assert got == {i: top(i) for i in parent} and len(rows) > 100


def test_mixing_targets(spark):
    """Taken words of each source near its target, no document over twice its size, on a whole table."""
    got = QUERIES["op9_mixing"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: (r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    by = collections.defaultdict(list)
    for r in got:
        text, source = texts[r.doc_id]
        assert r["size"] == len(words(text)) and r.taken in (0, r["size"], 2 * r["size"])
        by[source].append(r)
    sizes = {s: sum(r["size"] for r in rows) for s, rows in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # refill until nobody is above the cap
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
        if not open_:
            break
    for s, rows in by.items():
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sizes[s] for r in rows)
        longest = max(r["size"] for r in rows)
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(1, longest / 2)


def test_pipeline(spark):
    rows = QUERIES["pipeline"](spark, SF).collect()
    assert rows and all(r.length <= 2048 for r in rows)


def test_stages_against_brute_force(spark, tmp_path):
    """Planted copies, junk and clean documents through all stages, with null ids, repeated rows and clashing columns."""
    import corpus_pipeline

    rng = random.Random(11)
    clean = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i]) for i in range(10)]  # exact copies
    rows += [(200 + i, clean[i] + " more") for i in range(10, 15)]  # near copies
    rows += [(300, "short"), (301, None), (302, ""), (303, "the same eight words come round and round " * 9), (None, clean[39] + " null id"), (None, None), (5, clean[5]), (7, "other text of a known id " + clean[20][200:])]
    cols = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, component_id string"
    frame = lambda r: spark.createDataFrame([(i, t, "en", "s", 1, "k", "z", "c") for i, t in r], cols)
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts_of = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    good = stages["quality rules"](spark, frame(rows), str(tmp_path))
    want = collections.Counter((i, t) for i, t in rows if t is not None and len(words(t)) >= 20 and not t.startswith("the same"))
    assert texts_of(good) == want and good.columns == frame(rows).columns
    once = stages["exact dedup"](spark, good, str(tmp_path))
    keep = {}
    for i, t in want:
        keep[t] = i if t not in keep else min(keep[t], i)
    assert texts_of(once) == collections.Counter((i, t) for t, i in keep.items())
    one = stages["near dedup"](spark, once, str(tmp_path))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    items = sorted(((i, t) for t, i in keep.items()), key=lambda x: (x[0] is None, x[0] or 0))
    kept = []
    for k, (i, t) in enumerate(items):
        if not any(len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(t) | shingles(u)) for _, u in items[:k]):
            kept.append((i, t))
    assert texts_of(one) == collections.Counter(kept) and 30 < len(kept) < len(items)
    mix = stages["mixing"](spark, one, str(tmp_path))
    times = texts_of(mix)
    assert set(times) <= set(kept) and max(times.values()) <= 2
    size = lambda c: sum(len(words(t)) * n for (_, t), n in c.items())
    assert abs(size(times) - 1.5 * size(collections.Counter(kept))) <= 61
    packed = stages["packing"](spark, mix, str(tmp_path)).collect()
    ids = {t: [*library().encode(t, add_special_tokens=False).ids, 0] for _, t in kept}
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in packed) == collections.Counter({(i, zlib.crc32(np.array(ids[t], "<u4").tobytes())): n for (i, t), n in times.items()})
    ends = collections.defaultdict(int)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    nothing = frame(rows[:1]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
