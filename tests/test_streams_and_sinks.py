"""Streaming operators against their batch forms, and sources and sinks on small folders."""

import collections
import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from marketloom.operators import decisions as D
from marketloom.operators import relational as R
from marketloom.sources import tables as T
from marketloom.streaming import events as S

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    """Events in four files by time; a last event far ahead lets all windows before it close."""
    path = str(tmp_path_factory.mktemp("stream"))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    rows = sorted(e.collect(), key=lambda r: (r.ts, r.event_id))
    far = spark.createDataFrame([(10**9, 999, "end", 0.0)], "event_id long, user_id long, event_type string, value double")
    for k in range(4):
        part = spark.createDataFrame(rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(path)
    far.select("event_id", F.lit("2040-01-01").cast("timestamp").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(path)
    return path, e


def streamed(spark, path, op, tmp_path, mode="append"):
    source = S.read_events(spark, path, spark.read.parquet(path).schema, 1)
    S.run_once(op(source), f"{tmp_path}/out", f"{tmp_path}/check", mode)
    return spark.read.parquet(f"{tmp_path}/out")


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_dedup(spark, arrived, tmp_path):
    path, e = arrived
    got = streamed(spark, path, lambda x: S.dedup(x.unionByName(x), ["event_id"]), tmp_path)
    assert counted(got.filter("user_id <> 999"), "event_id") == counted(e, "event_id")


def test_tumbling(spark, arrived, tmp_path):
    path, e = arrived
    got = streamed(spark, path, S.tumbling, tmp_path).filter("event_type <> 'end'")
    want = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert counted(got, "start", "event_type", "n") == counted(want, "start", "event_type", "n")


def test_last_click_equals_the_batch_form(spark, arrived, tmp_path):
    path, e = arrived
    got = streamed(spark, path, lambda x: S.last_click(x.replace("end", "click", "event_type"), 24), tmp_path)  # the far event is to move the watermark
    want = R.asof_last(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'click'"), "user_id", 24)
    assert counted(got, "event_id", "user_id", "ts", "click_ts") == counted(want, "event_id", "user_id", "ts", "click_ts")
    assert got.filter("click_ts IS NOT NULL").count() > 0


def test_last_click_waits_for_the_watermark_and_drops_late_rows(spark, tmp_path):
    at = lambda hours: dt.datetime(2026, 1, 1) + dt.timedelta(hours=hours)
    files = [
        [(1, at(0), 1, "click", 0.0), (2, at(10), 1, "purchase", 0.0), (3, at(10), 2, "purchase", 0.0)],
        [(4, at(9.5), 1, "click", 0.0), (5, at(10.5), 1, "click", 0.0)],  # out of order, but within the hour
        [(6, at(100), 3, "click", 0.0)],
        [(7, at(9.9), 1, "click", 0.0), (8, at(20), 1, "purchase", 0.0)],  # late: the watermark is at 99 hours
        [(9, at(300), 3, "purchase", 0.0), (10, at(400), 4, "click", 0.0)],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(1.1)  # files are taken in the order of their times
    got = streamed(spark, f"{tmp_path}/in/*", S.last_click, tmp_path)
    assert {(r.event_id, r.click_ts, r.late) for r in got.collect()} == {(2, at(9.5), False), (3, None, False), (7, None, True), (8, None, True), (9, None, False)}


def test_sliding_and_sessions(spark, arrived, tmp_path):
    path, e = arrived
    got = streamed(spark, path, lambda x: S.sliding(x, "2 days", "1 day"), tmp_path / "a").filter("user_id <> 999")
    want = e.groupBy(F.window("ts", "2 days", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), "user_id", "n")
    assert counted(got, "until", "user_id", "n") == counted(want, "until", "user_id", "n")
    got = streamed(spark, path, S.sessions, tmp_path / "b").filter("user_id <> 999")
    want = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("first_ts"), "n")
    assert counted(got, "user_id", "first_ts", "n") == counted(want, "user_id", "first_ts", "n")


def test_attribution(spark, arrived, tmp_path):
    path, e = arrived
    op = lambda x: S.attribute(x.filter("event_type = 'click'"), x.filter("event_type = 'purchase'"), 48)
    got = streamed(spark, path, op, tmp_path)
    c = e.filter("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("ts").alias("click_ts"))
    p = e.filter("event_type = 'purchase'")
    want = p.join(c, (p.user_id == c.u) & (c.click_ts <= p.ts) & (c.click_ts >= p.ts - F.expr("INTERVAL 48 HOURS")))
    assert counted(got, "event_id", "click_ts") == counted(want, "event_id", "click_ts") and got.count()


def test_transitions(spark, arrived, tmp_path):
    path, e = arrived
    moves = {("new", "view"): "seen", ("seen", "click"): "keen", ("keen", "purchase"): "customer", ("customer", "view"): "seen"}
    got = streamed(spark, path, lambda x: S.transitions(x.filter("user_id <> 999"), moves, "new", 4000), tmp_path)
    want, state = collections.Counter(), collections.defaultdict(lambda: "new")
    for r in sorted(e.collect(), key=lambda r: (r.ts, r.event_id)):
        if to := moves.get((state[r.user_id], r.event_type)):
            want[r.user_id, r.ts, state[r.user_id], to] += 1
            state[r.user_id] = to
    assert counted(got, "user_id", "ts", "state_from", "state_to") == want and want


def test_sinks(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, at int")
    path = f"{tmp_path}/ignore"
    T.insert_ignore(rows((1, "a", 1), (1, "a", 1), (2, "b", 1)), path, ["k"])
    T.insert_ignore(rows((2, "x", 2), (3, "c", 2)), path, ["k"])
    assert counted(spark.read.parquet(path), "k", "v") == {(1, "a"): 1, (2, "b"): 1, (3, "c"): 1}
    one = T.upsert(rows((1, "a", 1), (2, "b", 1)), f"{tmp_path}/up", ["k"], "at")
    two = T.upsert(rows((2, "x", 2), (1, "old", 0), (3, "c", 2)), one, ["k"], "at")
    assert one != two and counted(spark.read.parquet(two), "k", "v") == {(1, "a"): 1, (2, "x"): 1, (3, "c"): 1}
    assert counted(spark.read.parquet(one), "k", "v") == {(1, "a"): 1, (2, "b"): 1}
    path = f"{tmp_path}/children"
    T.replace_children(rows((1, "a", 1), (1, "b", 1), (2, "c", 1)), path, "k")
    T.replace_children(rows((1, "z", 2)), path, "k")
    assert counted(spark.read.parquet(path), "k", "v") == {(1, "z"): 1, (2, "c"): 1}


def test_sources(spark, tmp_path):
    folder = tmp_path / "json" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"id": 1, "name": "x"}))
    (folder.parent / "b.json").write_text(json.dumps({"id": 2, "name": None, "more": []}))
    (folder / "c.txt").write_text("no")
    schema = spark.createDataFrame([], "id int, name string").schema
    docs = T.json_files(spark, str(tmp_path / "json"), schema)
    assert counted(docs, "id", "name") == {(1, "x"): 1, (2, None): 1}
    ledger = docs.filter("id = 1").select("content_hash")
    assert [r.id for r in T.json_files(spark, str(tmp_path / "json"), schema, ledger).collect()] == [2]
    assert T.file_hashes(spark, str(folder)).count() == 2
    for name, text in (("old.csv", "id,name\n1,Alpha \n2,Beta\n"), ("own.csv", "id,name\n9,alpha\n")):
        (tmp_path / name).write_text(text)
    seed = T.csv_seed(spark, str(tmp_path / "old.csv"), str(tmp_path / "own.csv"), schema, "id", F.lower(F.trim("name")))
    assert counted(seed, "id", "name") == {(9, "alpha"): 1, (2, "Beta"): 1}


def test_filter_documents(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "xbz")], "k int, v string")
    doc = {"or": [{"and": [{"column": "k", "op": "gt", "value": 1}, {"not": {"column": "v", "op": "is_null", "value": True}}]}, {"column": "v", "op": "ilike", "value": "A%"}]}
    assert [r.k for r in df.filter(T.compile_filter(doc, {"k", "v"})).orderBy("k").collect()] == [1, 3]
    for bad in ({"column": "x", "op": "eq", "value": 1}, {"column": "k", "op": "drop", "value": 1}):
        with pytest.raises(ValueError):
            T.compile_filter(bad, {"k", "v"})
    deep = {"column": "k", "op": "eq", "value": 1}
    for _ in range(12):
        deep = {"not": deep}
    with pytest.raises(ValueError):
        T.compile_filter(deep, {"k"})


def test_nested_children_and_hierarchy(spark):
    docs = spark.createDataFrame(
        [(1, "t", [("c", [("s", 5), ("t", 6)]), ("empty", [])], ["x"]), (2, None, [], None)],
        "id int, title string, categories array<struct<name:string,services:array<struct<name:string,price:int>>>>, notes array<string>",
    )
    out = D.nested_children(docs.drop("notes"), "id", {"categories": "categories"}, {"services": ("categories", "services")})
    assert counted(out["parent"], "id", "title") == {(1, "t"): 1, (2, None): 1}
    assert counted(out["categories"], "id", "position", "name") == {(1, 0, "c"): 1, (1, 1, "empty"): 1}
    assert counted(out["services"], "id", "categories_position", "position", "name", "price") == {(1, 0, 0, "s", 5): 1, (1, 0, 1, "t", 6): 1}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 4)], "parent int, child int")
    roots = spark.createDataFrame([(1,)], "id int")
    assert counted(D.descendants(spark, edges, roots), "id", "depth") == {(1, 0): 1, (2, 1): 1, (3, 2): 1, (4, 1): 1}
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "parent int, child int")
    with pytest.raises(RuntimeError):
        D.descendants(spark, chain, spark.createDataFrame([(0,)], "id int"), depth=3)


def test_canonical_json(spark):
    docs = [('{"b": [ {"t": 1, "a": "é"} ], "t": 2, "a": null}', '{"a":null,"b":[{"a":"é"}]}'), ("[1, 2.50]", "[1,2.5]"), ("{", None), (None, None)]
    df = spark.createDataFrame(docs, "doc string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", D.canonical_json(["t"])("doc")).collect())
