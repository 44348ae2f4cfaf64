"""Queries on joins: semi, anti, fallback, geo, band and as-of."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.operators import relational as R
from marketloom.plans.offers import OFFERS
from marketloom.sources.tables import entities, events, offers, table

ENTITY = """entity AS (SELECT s_suppkey AS id, s_nationkey AS region, s_acctbal AS score, 52 + ((s_suppkey * 7919) % 1000) / 5000 AS lat,
  21 + ((s_suppkey * 104729) % 1000) / 5000 AS lng FROM supplier)"""


def distance(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"12742000.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lng2} - {lng1}) / 2), 2))))"
    )


def subjects(s, d):
    return offers(s, d).select("entity", "category").distinct()


def anti_missing(s, d):
    """Brands' categories that other entities of the region have and the entity lacks, with the number of peers."""
    o = offers(s, d).select("entity", "brand", "category").distinct().join(entities(s, d).select(F.col("id").alias("entity"), "region"), "entity")
    peers = o.groupBy("region", "brand", "category").agg(F.count("*").alias("n_peers"))
    missing = o.select("entity", "region").distinct().join(peers, "region").join(o.select("entity", "brand", "category"), ["entity", "brand", "category"], "left_anti")
    return missing.select("entity", "brand", "category", "n_peers")


def anti_unique(s, d):
    """Categories that an entity alone has in its region."""
    o = subjects(s, d).join(entities(s, d).select(F.col("id").alias("entity"), "region"), "entity")
    alone = o.groupBy("region", "category").agg(F.count("*").alias("n"), F.min("entity").alias("entity")).filter("n = 1")
    return alone.select("entity", "category")


def fallback(s, d):
    o = offers(s, d)
    level = lambda *k: o.groupBy(*k).agg(F.percentile("price", F.lit(0.5)).alias("median"), F.count_distinct("entity").alias("n")).filter("n >= 3")
    rows = o.select("category", "brand").distinct()
    return R.fallback_join(rows, [(level("category", "brand"), ["category", "brand"]), (level("category"), ["category"])], "median")


def overlay(s, d):
    """Customers with their nation's name where known, else the region's first nation."""
    c, n = table(s, d, "customer"), table(s, d, "nation").filter("n_nationkey % 4 <> 0")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", F.coalesce(X.blank_to_null(F.col("n_name")), F.lit("unknown")).alias("nation"))


def cross_due(s, d):
    """Category and region combinations that had no order in the last quarter, never served first."""
    part = table(s, d, "part").select("p_brand").distinct()
    combos = part.join(table(s, d, "region").select("r_name"))  # two small dimensions: every combination is the result
    served = offers(s, d).join(entities(s, d).select(F.col("id").alias("entity"), "region"), "entity").join(
        table(s, d, "nation"), F.col("region") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    last = served.groupBy(F.col("brand").alias("p_brand"), "r_name").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return combos.join(last, ["p_brand", "r_name"], "left").select("p_brand", "r_name", "last_ts", F.coalesce("n", F.lit(0)).alias("n"))


def geo_radius(s, d):
    return R.geo_pairs(entities(s, d), 5000.0)


def geo_nearest_k(s, d):
    return R.geo_nearest(entities(s, d), 52.1, 21.1, 12000.0, 20).select("id", F.round("distance_m", 3).alias("distance_m"))


def band_join(s, d):
    o = offers(s, d).withColumn("oid", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "price"))
    o = o.groupBy("entity", "brand", "oid").agg(F.min("price").alias("price"))
    return R.band_pairs(o, ["entity", "brand"], "oid", "price", 1.1)


def asof(s, d):
    e = events(s, d)
    kinds = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.asof_last(kinds, e.filter("event_type = 'click'"), "user_id", 168)


QUERIES = {
    "semi_entities": lambda s, d: entities(s, d).join(offers(s, d).filter("promo").select(F.col("entity").alias("id")), "id", "left_semi").select("id", "region"),
    "anti_missing": anti_missing,
    "anti_unique": anti_unique,
    "fallback_join": fallback,
    "coalesce_overlay": overlay,
    "cross_due": cross_due,
    "geo_radius": geo_radius,
    "geo_nearest_k": geo_nearest_k,
    "band_join_price": band_join,
    "asof_last_click": asof,
    "bridge_join": lambda s, d: offers(s, d).join(entities(s, d).select(F.col("id").alias("entity"), "region"), "entity").join(
        table(s, d, "nation"), F.col("region") == F.col("n_nationkey")).groupBy("n_name").agg(F.array_sort(F.collect_set("brand")).alias("brands")).select(
        "n_name", F.array_join("brands", ",").alias("brands")),
}

_placed = "o AS (SELECT DISTINCT entity, category, s_nationkey AS region FROM offers JOIN supplier ON entity = s_suppkey)"
ORACLES = {
    "semi_entities": f"WITH {OFFERS}, {ENTITY} SELECT id, region FROM entity WHERE id IN (SELECT entity FROM offers WHERE promo)",
    "anti_missing": f"""WITH {OFFERS}, o AS (SELECT DISTINCT entity, brand, category, s_nationkey AS region FROM offers JOIN supplier ON entity = s_suppkey), p AS (SELECT region, brand, category, count(*) AS n_peers FROM o GROUP BY 1, 2, 3),
      m AS (SELECT DISTINCT entity, region FROM o) SELECT entity, brand, category, n_peers FROM m JOIN p USING (region) WHERE (entity, brand, category) NOT IN (SELECT (entity, brand, category) FROM o)""",
    "anti_unique": f"WITH {OFFERS}, {_placed} SELECT min(entity) AS entity, category FROM o GROUP BY region, category HAVING count(*) = 1",
    "fallback_join": f"""WITH {OFFERS}, a AS (SELECT category, brand, quantile_cont(price, 0.5) AS m FROM offers GROUP BY 1, 2 HAVING count(DISTINCT entity) >= 3),
      b AS (SELECT category, quantile_cont(price, 0.5) AS m FROM offers GROUP BY 1 HAVING count(DISTINCT entity) >= 3), r AS (SELECT DISTINCT category, brand FROM offers)
      SELECT r.category, r.brand, coalesce(a.m, b.m) AS median FROM r LEFT JOIN a ON a.category = r.category AND a.brand = r.brand LEFT JOIN b ON b.category = r.category""",
    "coalesce_overlay": "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 4 <> 0",
    "cross_due": f"""WITH {OFFERS}, c AS (SELECT * FROM (SELECT DISTINCT p_brand FROM part), (SELECT r_name FROM region)),
      l AS (SELECT brand, r_name, max(ts) AS last_ts, count(*) AS n FROM offers JOIN supplier ON entity = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
      SELECT c.p_brand, c.r_name, last_ts, coalesce(n, 0) AS n FROM c LEFT JOIN l ON l.brand = c.p_brand AND l.r_name = c.r_name""",
    "geo_radius": f"""WITH {ENTITY}, p AS (SELECT a.id AS a_id, b.id AS b_id, {distance('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS m FROM entity a JOIN entity b ON a.id < b.id)
      SELECT a_id, b_id, round(m, 3) AS distance_m FROM p WHERE m <= 5000""",
    "geo_nearest_k": f"WITH {ENTITY}, p AS (SELECT id, {distance('52.1', '21.1', 'lat', 'lng')} AS m FROM entity) SELECT id, round(m, 3) AS distance_m FROM p WHERE m <= 12000 ORDER BY m, id LIMIT 20",
    "band_join_price": f"""WITH {OFFERS}, o AS (SELECT entity, brand, concat_ws('/', l_orderkey, l_linenumber, l_partkey, price) AS oid, min(price) AS price FROM offers GROUP BY 1, 2, 3)
      SELECT a.entity, a.brand, a.oid AS a_id, a.price AS a_value, b.oid AS b_id, b.price AS b_value FROM o a JOIN o b ON a.entity = b.entity AND a.brand = b.brand AND a.oid < b.oid
      WHERE greatest(a.price, b.price) <= 1.1 * least(a.price, b.price)""",
    "asof_last_click": """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS click FROM events WHERE event_type = 'click')
      SELECT p.event_id, p.user_id, p.ts, max(click) FILTER (click >= p.ts - INTERVAL 168 HOUR) AS click_ts FROM p LEFT JOIN c ON c.user_id = p.user_id AND click <= p.ts GROUP BY 1, 2, 3""",
    "bridge_join": f"WITH {OFFERS} SELECT n_name, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands FROM offers JOIN supplier ON entity = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
}
