"""Queries that write tables and streams and return what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom.operators import ledger as L
from marketloom.operators.staging import shared_dir
from marketloom.sources import tables as T
from marketloom.sources.tables import table
from marketloom.streaming import events as S

#: The fixture's three batches of orders, by their year.
BATCHES = [(0, 1994), (1995, 1996), (1997, 9999)]


def fresh(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex[:12]}"


def snapshot_ledger(s, d):
    """Each customer's orders as sights of one document, committed in three batches; every version folded back from its chain."""
    o = table(s, d, "orders")
    tags = F.array("o_orderpriority", "o_orderstatus")
    doc = F.to_json(F.struct(F.struct(tags.alias("tags"), F.col("o_orderstatus").alias("a/b")).alias("state"), F.col("o_orderkey").alias("view_count")))
    seen = o.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderdate").cast("timestamp").alias("ts"), doc.alias("document"))
    path = fresh(s, "ledger")
    for n, (first, last) in enumerate(BATCHES):
        L.commit(seen.filter(F.year("ts").between(first, last)), path, n, ["view_count"], 4)
    rows = L.read(s, path)
    return L.versions(rows).join(rows.select("key", "version", "first_seen", "last_seen", "n_seen"), ["key", "version"])


def upserted(s, d):
    """The newest order of each customer, upserted in two goes."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    path = T.upsert(o.filter("o_orderkey % 3 = 0"), fresh(s, "upsert"), ["o_custkey"], "o_orderkey")
    return s.read.parquet(T.upsert(o.filter("o_orderkey % 3 <> 0"), path, ["o_custkey"], "o_orderkey"))


def inserted(s, d):
    """Customers with orders, put in twice: the second time only new ones stay."""
    o = table(s, d, "orders")
    path = fresh(s, "insert")
    for part, tag in (("o_orderkey % 5 = 0", "first"), ("true", "second")):
        T.insert_ignore(o.filter(part).select("o_custkey", F.lit(tag).alias("tag")), path, ["o_custkey"])
    return s.read.parquet(path)


def replaced(s, d):
    """Nations' customers by region: written whole, then the children of two regions replaced by those in debt."""
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey", "c_acctbal")
    path = fresh(s, "children")
    T.append(c, path, ["n_regionkey"])
    T.replace_children(c.filter("n_regionkey IN (1, 3) AND c_acctbal < 0"), path, "n_regionkey")
    return s.read.parquet(path).groupBy(F.col("n_regionkey").cast("int").alias("region")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids"))


def stream(s, d):
    """The event table as a stream; the glob also takes a single file."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return S.read_events(s, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def streamed_windows(s, d):
    path = fresh(s, "windows")
    S.run_complete(S.tumbling(stream(s, d)), path, fresh(s, "windows-state"))
    return s.read.parquet(path).withColumn("total", F.round("total", 2))


def streamed_clicks(s, d):
    """The last click before each purchase that the watermark has passed: all but those of the last hour."""
    path = fresh(s, "clicks")
    S.run_once(S.last_click(stream(s, d)), path, fresh(s, "clicks-state"))
    return s.read.parquet(path).filter("NOT late").drop("late")


QUERIES = {
    "snapshot_ledger": snapshot_ledger,
    "sink_upsert": upserted,
    "sink_insert_ignore": inserted,
    "sink_replace_children": replaced,
    "stream_windows": streamed_windows,
    "stream_last_click": streamed_clicks,
}

ORACLES = {
    "snapshot_ledger": """WITH x AS (SELECT o_custkey::VARCHAR AS key, o_orderdate::TIMESTAMP AS ts, '{"state":{"a/b":"' || o_orderstatus || '","tags":["' || o_orderpriority || '","' || o_orderstatus || '"]}}' AS document FROM orders),
      h AS (SELECT *, sha256(document) AS content_hash FROM x), n AS (SELECT *, (content_hash IS DISTINCT FROM lag(content_hash) OVER (PARTITION BY key ORDER BY ts, content_hash))::INT AS new FROM h),
      r AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, content_hash ROWS UNBOUNDED PRECEDING) AS version FROM n)
      SELECT key, version::BIGINT AS version, content_hash, any_value(document) AS document, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_seen FROM r GROUP BY key, version, content_hash""",
    "sink_upsert": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "sink_insert_ignore": "SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 5 = 0) THEN 'first' ELSE 'second' END AS tag FROM orders GROUP BY 1",
    "sink_replace_children": "SELECT n_regionkey AS region, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey NOT IN (1, 3) OR c_acctbal < 0 GROUP BY 1",
    "stream_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_last_click": """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' AND ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IN ('click', 'purchase'))), c AS (SELECT user_id, ts AS click FROM events WHERE event_type = 'click')
      SELECT p.event_id, p.user_id, p.ts, max(click) FILTER (click >= p.ts - INTERVAL 168 HOUR) AS click_ts FROM p LEFT JOIN c ON c.user_id = p.user_id AND click <= p.ts GROUP BY 1, 2, 3""",
}
