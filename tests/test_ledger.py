"""Patches by property, the ledger against a plain history, reruns, gates, late rows and a stream."""

import datetime as dt
import hashlib
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.operators import ledger as L
from marketloom.operators.custom import patched

LEAF = st.none() | st.booleans() | st.integers(-2, 2) | st.floats(0, 1, width=16) | st.text(alphabet="a/~é", max_size=3)
DOCUMENT = st.recursive(LEAF, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(alphabet="a/~b01", max_size=2), x, max_size=4), max_leaves=12)
SCHEMA = "key string, ts timestamp, document string, ready boolean"


@settings(max_examples=500, deadline=None)
@given(DOCUMENT, DOCUMENT)
def test_a_patch_leads_from_one_document_to_another(old, new):
    ops = json.loads(json.dumps(L.patch(old, new)))
    assert L.same(patched(old, ops), new)
    assert (ops == []) == L.same(old, new)


@settings(max_examples=100, deadline=None)
@given(st.lists(DOCUMENT, min_size=2, max_size=6))
def test_a_chain_leads_back_to_every_version(history):
    now = history[-1]
    for newer, older in zip(history[:0:-1], history[-2::-1], strict=True):
        now = patched(now, L.patch(newer, older))
        assert L.same(now, older)


def test_patches_are_small():
    assert L.patch({"a": [1, 2, 3, 4], "b": 1}, {"a": [1, 9, 3, 4], "b": 1}) == [{"op": "replace", "path": "/a/1", "value": 9}]
    assert L.patch({"x/y": {"~": 1}}, {"x/y": {}}) == [{"op": "remove", "path": "/x~1y/~0"}]
    assert L.patch([1, 2, 3], [1, 3]) == [{"op": "remove", "path": "/1"}] and L.patch([1], [1, 2]) == [{"op": "add", "path": "/1", "value": 2}]
    assert L.patch(1, True) == [{"op": "replace", "path": "", "value": True}]


def history(seed=3, keys=6, days=25):
    rng, rows = random.Random(seed), []
    docs = {k: {"name": f"n{k}", "offers": [{"p": 1}, {"p": 2}]} for k in range(keys)}
    for day in range(days):
        for k, doc in docs.items():
            if rng.random() < 0.6:
                doc["offers"][rng.randrange(len(doc["offers"]))] = {"p": rng.randrange(4)}
            if rng.random() < 0.1:
                doc["offers"].append({"p": None})
            rows.append((f"k{k}", dt.datetime(2026, 1, 1) + dt.timedelta(days=day), json.dumps(doc | {"view_count": rng.random()}), True))
    return rows


def runs(rows):
    """What the ledger should hold: (key, version, document, first and last sight, sights)."""
    out = []
    for key in sorted({r[0] for r in rows}):
        own = []
        for _, ts, text, _ in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            doc = L.compact({k: v for k, v in json.loads(text).items() if k != "view_count"})
            if own and own[-1][0] == doc:
                own[-1][2], own[-1][3] = ts, own[-1][3] + 1
            else:
                own.append([doc, ts, ts, 1])
        out += [(key, n + 1, hashlib.sha256(x[0].encode()).hexdigest(), *x) for n, x in enumerate(own)]
    return out


def held(spark, path):
    rows = L.read(spark, path)
    seen = {(r.key, r.version): (r.first_seen, r.last_seen, r.n_seen) for r in rows.collect()}
    return sorted((r.key, r.version, r.content_hash, r.document, *seen[r.key, r.version]) for r in L.versions(rows).collect())


def test_ledger_in_batches_equals_the_history_and_reruns_change_nothing(spark, tmp_path):
    path, rows = f"file://{tmp_path}/ledger", history()
    days = sorted({r[1] for r in rows})
    parts = [days[:1], days[1:9], days[9:10], days[10:]]
    for n, part in enumerate(parts):
        batch = spark.createDataFrame([r for r in rows if r[1] in part], SCHEMA)
        L.commit(batch, path, n, ["view_count"], every=5)
        if n == 2:  # once more, as after a lost driver, with half of the batch and then with all of it
            L.commit(batch.limit(2), path, n, ["view_count"], every=5)
            L.commit(batch.repartition(3), path, n, ["view_count"], every=5)
    assert held(spark, path) == runs(rows)
    ledger = L.read(spark, path).collect()
    newest = {k: max(r.version for r in ledger if r.key == k) for k in {r.key for r in ledger}}
    assert all((r.document is not None) == (r.version == newest[r.key] or r.version % 5 == 0) for r in ledger)
    (tmp_path / "ledger" / "batch=3" / "_SUCCESS").unlink()  # a batch that was never completed does not count
    assert held(spark, path) == runs([r for r in rows if r[1] <= days[9]])


def test_gate_late_rows_and_nulls(spark, tmp_path):
    path, day = f"file://{tmp_path}/ledger", lambda n: dt.datetime(2026, 1, n)
    L.commit(spark.createDataFrame([("a", day(5), '{"v":1}', True), ("b", day(5), '{"v":1}', False), (None, day(5), "{}", True), ("c", day(5), "{", True), ("d", None, "{}", True)], SCHEMA), path, 0, [])
    assert [(r.key, r.n_seen) for r in L.heads(L.read(spark, path)).collect()] == [("a", 1)]
    L.commit(spark.createDataFrame([("a", day(3), '{"v":0}', True), ("a", day(6), '{"v":2}', False), ("b", day(6), '{"v":1}', None), ("a", day(7), '{ "v": 1 }', True)], SCHEMA), path, 1, [])
    head = L.heads(L.read(spark, path)).collect()
    assert [(r.key, r.version, r.n_seen, r.last_seen, r.document) for r in head] == [("a", 1, 3, day(7), '{"v":1}')]
    L.commit(spark.createDataFrame([], SCHEMA), path, 2, [])
    assert L.read(spark, path).count() == 1


def test_ledger_of_a_stream(spark, tmp_path):
    rows = history(8, 3, 6)
    for n in range(3):
        spark.createDataFrame(rows[n * 6 : n * 6 + 6], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{n}")
    path = f"file://{tmp_path}/ledger"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in/*")
    query = stream.writeStream.foreachBatch(lambda df, n: L.commit(df, path, n, ["view_count"], 3)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert held(spark, path) == runs(rows)


def test_chains_share_batches(spark):
    """Many short chains are folded together: a group of its own for each costs a call into Python."""
    docs = [("a", 1, "h1", None, '[{"op": "add", "path": "/x/0", "value": 1}]'), ("a", 2, "h2", '{"x": [2]}', None), ("a", 3, "h3", None, "[]"), ("b", 1, "h4", None, '[{"op": "remove", "path": "/no"}]'),
            ("b", 2, "h5", '{"y": null}', None), ("c", 1, "h6", None, "no json"), ("c", 2, "h7", '"t"', None), (None, 1, "h8", "7", None)]
    rows = spark.createDataFrame(docs, "key string, version long, content_hash string, document string, ops string").repartition(3)
    got = {(r.key, r.version): (r.content_hash, r.document) for r in L.versions(rows).collect()}
    assert got == {("a", 1): ("h1", '{"x":[1,2]}'), ("a", 2): ("h2", '{"x":[2]}'), ("a", 3): ("h3", None), ("b", 1): ("h4", None), ("b", 2): ("h5", '{"y":null}'),
                   ("c", 1): ("h6", None), ("c", 2): ("h7", '"t"'), (None, 1): ("h8", "7")}
    assert "FlatMapGroupsInPandas" not in L.versions(rows)._jdf.queryExecution().toString()
