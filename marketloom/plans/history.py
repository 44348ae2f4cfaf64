"""Queries on snapshot history: runs, diffs, alerts, rebuilt rows and exact text repeats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.operators import relational as R
from marketloom.sources.tables import offers, table


def numbered(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(s, d, "orders").withColumn("rn", F.row_number().over(w))


def snapshots(s, d, year):
    o = offers(s, d).filter(F.year("ts") == year)
    return o.groupBy("entity", "category").agg(F.expr("sum(price) div count(*)").alias("price"), F.max("minutes").alias("minutes"))


def diff(s, d):
    return R.snapshot_diff(snapshots(s, d, 1995), snapshots(s, d, 1996), ["entity", "category"], "price", "minutes")


def deltas(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")
    only = lambda c: F.when(F.lag(c).over(w).eqNullSafe(F.col(c)), None).otherwise(F.col(c))
    return o.withColumns({c: only(c) for c in ("o_orderstatus", "o_orderpriority")})


def price_moves(s, d):
    """Latest against previous order of each customer, with the change in per cent and its severity."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(s, d, "orders").withColumn("before", F.lag("o_totalprice").over(w)).filter("before IS NOT NULL")
    pct = F.round(100 * (F.col("o_totalprice") - F.col("before")) / F.col("before"), 1)
    return o.withColumn("change_pct", pct).select("o_orderkey", "change_pct", X.severity(F.col("change_pct")).alias("severity"))


def started_stopped(s, d):
    """What each entity's brands' categories started and stopped from one year to the next."""
    key = ["entity", "brand", "category"]
    o = offers(s, d).select(*key, F.year("ts").alias("y"))
    return R.active_set_diff(o.filter("y = 1995").select(*key).distinct(), o.filter("y = 1996").select(*key).distinct(), key)


QUERIES = {
    "content_hash_runs": lambda s, d: R.snapshot_runs(table(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).drop("content_hash"),
    "consecutive_delta": price_moves,
    "snapshot_diff": diff,
    "reconstruct_rows": lambda s, d: R.reconstruct(deltas(s, d), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).drop("o_orderdate"),
    "active_set_diff": started_stopped,
    "dedup_exact_text": lambda s, d: table(s, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")),
    "fingerprint_set": lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "o_orderkey", F.floor(F.col("o_totalprice") / 7)))), ",")).alias("fingerprint")),
}

_w = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_snap = """SELECT l_suppkey AS entity, p_type AS category, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // count(*) AS BIGINT) AS price, CAST(max(CAST(l_quantity AS INTEGER)) AS INTEGER) AS minutes
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = {y} GROUP BY 1, 2"""
_pairs = "SELECT DISTINCT l_suppkey AS entity, p_brand AS brand, p_type AS category FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = {y}"
ORACLES = {
    "content_hash_runs": f"""WITH a AS (SELECT *, CAST(lag(o_orderstatus) {_w} IS DISTINCT FROM o_orderstatus AS INTEGER) AS n FROM orders), r AS (SELECT *, sum(n) {_w} AS run FROM a)
      SELECT o_custkey, CAST(run AS BIGINT) AS run, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts, count(*) AS n_seen FROM r GROUP BY o_custkey, run""",
    "consecutive_delta": f"""WITH a AS (SELECT o_orderkey, o_totalprice AS p, lag(o_totalprice) {_w} AS b FROM orders), c AS (SELECT o_orderkey, round(100 * (p - b) / b, 1) + 0.0 AS change_pct FROM a WHERE b IS NOT NULL)
      SELECT *, CASE WHEN change_pct > 20 THEN 'critical' WHEN abs(change_pct) >= 5 THEN 'warning' ELSE 'info' END AS severity FROM c""",
    "snapshot_diff": f"""WITH a AS ({_snap.format(y=1995)}), b AS ({_snap.format(y=1996)}) SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.category, b.category) AS category, a.price AS old_price,
      a.minutes AS old_minutes, b.price AS new_price, b.minutes AS new_minutes, CASE WHEN a.entity IS NULL THEN 'added' WHEN b.entity IS NULL THEN 'removed' WHEN a.price <> b.price THEN 'price_changed'
      WHEN a.minutes <> b.minutes THEN 'duration_changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.entity = b.entity AND a.category = b.category""",
    "reconstruct_rows": "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders",
    "active_set_diff": f"""WITH a AS ({_pairs.format(y=1995)}), b AS ({_pairs.format(y=1996)}) SELECT *, 'started' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
      UNION ALL SELECT *, 'stopped' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "dedup_exact_text": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "fingerprint_set": "SELECT o_custkey, sha1(string_agg(k, ',' ORDER BY k)) AS fingerprint FROM (SELECT o_custkey, concat_ws(':', o_orderkey, CAST(floor(o_totalprice / 7) AS BIGINT)) AS k FROM orders) GROUP BY 1",
}
