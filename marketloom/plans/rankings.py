"""Queries on ranking, top-k, set operations and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.operators import relational as R
from marketloom.operators.places import nearest_places
from marketloom.plans.joins import ENTITY, distance
from marketloom.plans.offers import KEY, KEYS, OFFERS
from marketloom.sources.tables import entities, offers, table


def key_columns():
    return [F.col(k) for k in KEY]


def entity_metrics(s, d):
    """Per entity: offers, distinct categories, mean price, and the entity's score."""
    m = offers(s, d).groupBy("entity").agg(
        F.count("*").alias("n"), F.count_distinct("category").alias("cats"), F.expr("sum(price) div count(*)").alias("mean_price")
    )
    return m.join(entities(s, d).select(F.col("id").alias("entity"), "region", "score"), "entity")


METRICS = f"""{OFFERS}, metrics AS (SELECT entity, count(*) AS n, count(DISTINCT category) AS cats, CAST(sum(price) // count(*) AS BIGINT) AS mean_price,
  any_value(s_nationkey) AS region, any_value(s_acctbal) AS score FROM offers JOIN supplier ON entity = s_suppkey GROUP BY 1)"""


def rivals_at(s, d, k=5):
    """``subject, rival, m``: each entity's k nearest others within five kilometres, with their distance."""
    e = entities(s, d).select("id", "lat", "lng")
    return nearest_places(e, e, k, 5000.0).select(F.col("a_id").alias("subject"), F.col("b_id").alias("rival"), F.col("distance_m").alias("m"))


def rivals(s, d, k=5):
    return rivals_at(s, d, k).drop("m")


RIVALS = f"""{ENTITY}, near AS (SELECT a.id AS subject, b.id AS rival, {distance('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS m FROM entity a JOIN entity b ON a.id <> b.id),
placed AS (SELECT subject, rival, row_number() OVER (PARTITION BY subject ORDER BY round(m, 3), rival) AS place FROM near WHERE m <= 5000),
rivals AS (SELECT subject, rival FROM placed WHERE place <= 5), nearest AS (SELECT subject, rival FROM placed WHERE place = 1)"""


def services(s, d):
    """``entity, service, n``: what each entity offers, a service being a brand's category."""
    return offers(s, d).groupBy("entity", F.concat_ws("/", "brand", "category").alias("service")).agg(F.count("*").alias("n"))


SERVICES = "services AS (SELECT entity, brand || '/' || category AS service, count(*) AS n FROM offers GROUP BY 1, 2)"


def of_pair(s, d, pairs):
    """The services of both entities of each pair: ``subject, rival, service, n_subject, n_rival``, 0 for lacking."""
    own = services(s, d)
    a = pairs.join(own, F.col("subject") == F.col("entity")).select("subject", "rival", "service", F.col("n").alias("n_subject"))
    b = pairs.join(own, F.col("rival") == F.col("entity")).select("subject", "rival", "service", F.col("n").alias("n_rival"))
    return a.join(b, ["subject", "rival", "service"], "full_outer").fillna(0, ["n_subject", "n_rival"])


OF_PAIR = """both_sides AS (SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.rival, b.rival) AS rival, coalesce(a.service, b.service) AS service, coalesce(a.n, 0) AS n_subject, coalesce(b.n, 0) AS n_rival
  FROM (SELECT subject, rival, service, n FROM {pairs} JOIN services ON entity = subject) a FULL JOIN (SELECT subject, rival, service, n FROM {pairs} JOIN services ON entity = rival) b USING (subject, rival, service))"""


def scored(s, d, pairs=None):
    """Each entity compared with its rivals, by size, categories, mean price and region; columns of ``pairs`` are kept."""
    pairs = rivals(s, d) if pairs is None else pairs
    m = entity_metrics(s, d)
    side = lambda p: m.select(F.col("entity").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "cats", "mean_price", "region")])
    return pairs.join(side("subject"), "subject").join(side("rival"), "rival").select(
        *pairs.columns,
        X.ratio_similarity(F.col("rival_n"), F.col("subject_n")).alias("size_sim"),
        X.ratio_similarity(F.col("rival_cats"), F.col("subject_cats")).alias("cat_sim"),
        X.ratio_similarity(F.col("rival_mean_price"), F.col("subject_mean_price")).alias("price_sim"),
        (F.col("rival_region") == F.col("subject_region")).cast("int").alias("same_region"),
    )


SCORED = f"""{METRICS}, {RIVALS},
scored AS (SELECT subject, rival, least(m.n, o.n) / greatest(m.n, o.n) AS size_sim, least(m.cats, o.cats) / greatest(m.cats, o.cats) AS cat_sim,
  CASE WHEN m.mean_price <= 0 OR o.mean_price <= 0 THEN 0.0 ELSE least(m.mean_price, o.mean_price) / greatest(m.mean_price, o.mean_price) END AS price_sim,
  CAST(m.region = o.region AS INTEGER) AS same_region FROM rivals JOIN metrics m ON m.entity = rival JOIN metrics o ON o.entity = subject)"""


def composite_v1(s, d):
    c = X.composite_v1(F.col("same_region"), F.col("size_sim"), F.col("cat_sim"), F.col("price_sim"), F.pmod(F.col("rival"), F.lit(12)))
    return scored(s, d).select("subject", "rival", F.round(c, 3).alias("composite"))


def composite_v2(s, d):
    c = X.composite_v2(F.col("same_region"), F.col("size_sim"), F.col("cat_sim"), F.col("price_sim"), F.lit(0.5), F.pmod(F.col("rival"), F.lit(12)))
    return scored(s, d).select("subject", "rival", F.round(c, 3).alias("composite"))


def bucket_v2(s, d):
    """The bucket of each rival: unlikeness of size as focus, price as embedding; reviews, profile and review ranks by number."""
    k, own = F.col("rival"), F.col("subject")
    b = X.bucket_v2(k * 37 % 100, 1 - F.col("size_sim"), (k * 13 + own * 7) % 10 / 10, F.col("price_sim"), k % 10 / 10, own % 10 / 10)
    return scored(s, d).select("subject", "rival", b.alias("bucket"))


def topn_union_picks(s, d):
    picks = s.range(1, 200, 37).select(F.col("id").alias("entity"))
    m = entity_metrics(s, d).select("entity", "score")
    return R.top_n_with_picks(m, [F.desc("score"), F.col("entity")], 10, picks, "entity")


def union_first_wins(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.union_first_wins([o.filter("o_totalprice > 200000"), o.filter("o_totalprice > 100000")], ["o_custkey"], [F.col("o_orderkey")])


def multiset_recall(s, d):
    """Share of an entity's services, weighted by their number, that each rival covers."""
    hit = F.sum(F.when(F.col("n_rival") > 0, F.col("n_subject")).otherwise(0))
    return of_pair(s, d, rivals(s, d)).groupBy("subject", "rival").agg(F.round(hit / F.sum("n_subject"), 4).alias("recall"))


QUERIES = {
    "latest_per_key": lambda s, d: R.latest_per_key(table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]),
    "lowest_price_per_key": lambda s, d: R.latest_per_key(offers(s, d), ["entity", "category"], [F.col("price").asc_nulls_last(), *key_columns()]).select("entity", "category", "price", *KEY),
    "top_k_per_group": lambda s, d: R.top_k(offers(s, d), ["category"], [F.desc("price"), *key_columns()], 3, "place").select("category", "price", "place", *KEY),
    "max_relative": lambda s, d: entity_metrics(s, d).select("entity", F.round(F.col("n") / F.max("n").over(R.Window.partitionBy("region")), 4).alias("relative")),
    "share_of_total": lambda s, d: offers(s, d).groupBy("entity", "category").agg(F.sum("price").alias("p")).select(
        "entity", "category", F.round(F.col("p") / F.sum("p").over(R.Window.partitionBy("entity")), 6).alias("share")),
    "composite_v1": composite_v1,
    "composite_v2": composite_v2,
    "bucket_v2": bucket_v2,
    "topn_union_picks": topn_union_picks,
    "union_first_wins": union_first_wins,
    "set_difference": lambda s, d: of_pair(s, d, rivals(s, d, 1)).filter("n_subject = 0").select("subject", "rival", "service"),
    "set_intersection": lambda s, d: of_pair(s, d, rivals(s, d, 1)).filter("n_subject > 0 AND n_rival > 0").select("subject", "rival", "service"),
    "multiset_recall": multiset_recall,
    "mode_per_key": lambda s, d: offers(s, d).groupBy("category", "brand").agg(F.count("*").alias("n")).groupBy("category").agg(
        F.max_by("brand", F.struct("n", "brand")).alias("brand")),
    "cross_category_repeats": lambda s, d: offers(s, d).select("brand", "category").distinct().groupBy("brand").agg((F.count("*") - 1).alias("repeats")),
}

_first = "row_number() OVER (PARTITION BY {k} ORDER BY {o}) = 1"
ORACLES = {
    "latest_per_key": f"SELECT * FROM orders QUALIFY {_first.format(k='o_custkey', o='o_orderdate DESC, o_orderkey DESC')}",
    "lowest_price_per_key": f"WITH {OFFERS} SELECT entity, category, price, {KEYS} FROM offers QUALIFY {_first.format(k='entity, category', o='price, ' + KEYS)}",
    "top_k_per_group": f"WITH {OFFERS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY price DESC, {KEYS}) AS place FROM offers) SELECT category, price, place, {KEYS} FROM r WHERE place <= 3",
    "max_relative": f"WITH {METRICS} SELECT entity, round(n / max(n) OVER (PARTITION BY region), 4) AS relative FROM metrics",
    "share_of_total": f"WITH {OFFERS}, g AS (SELECT entity, category, sum(price) AS p FROM offers GROUP BY 1, 2) SELECT entity, category, round(p / sum(p) OVER (PARTITION BY entity), 6) AS share FROM g",
    "composite_v1": f"WITH {SCORED} SELECT subject, rival, round(30 * same_region + 20 * size_sim + 25 * cat_sim + 10 * price_sim - 2 * greatest(0.0, rival % 12 - 5), 3) AS composite FROM scored",
    "composite_v2": f"WITH {SCORED} SELECT subject, rival, round(30 * same_region + 25 * size_sim + 20 * cat_sim + 20 * price_sim + 10 * 0.5 - 2 * greatest(0.0, rival % 12 - 5), 3) AS composite FROM scored",
    "bucket_v2": f"""WITH {SCORED}, x AS (SELECT *, 1 - size_sim AS focus, (rival * 13 + subject * 7) % 10 / 10 AS profile, rival * 37 % 100 AS reviews FROM scored)
      SELECT subject, rival, CASE WHEN reviews < 20 THEN 'new' WHEN (focus >= 0.25 OR profile >= 0.7) AND price_sim >= 0.85 THEN 'direct' WHEN focus >= 0.12 OR profile >= 0.4 THEN 'cluster'
        WHEN rival % 10 / 10 >= subject % 10 / 10 + 0.3 AND price_sim >= 0.70 THEN 'aspirational' END AS bucket FROM x""",
    "topn_union_picks": f"""WITH {METRICS}, p AS (SELECT unnest(range(1, 200, 37)) AS entity), m AS (SELECT entity, score, entity IN (SELECT entity FROM p) AS picked FROM metrics),
      best AS (SELECT * FROM m ORDER BY score DESC, entity LIMIT 10) SELECT * FROM best UNION ALL SELECT * FROM m WHERE picked AND entity NOT IN (SELECT entity FROM best)""",
    "union_first_wins": """WITH u AS (SELECT 0 AS f, o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 UNION ALL
      SELECT 1, o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000)
      SELECT o_custkey, o_orderkey, o_totalprice FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY f, o_orderkey) = 1""",
    "set_difference": f"WITH {OFFERS}, {RIVALS}, {SERVICES}, {OF_PAIR.format(pairs='nearest')} SELECT subject, rival, service FROM both_sides WHERE n_subject = 0",
    "set_intersection": f"WITH {OFFERS}, {RIVALS}, {SERVICES}, {OF_PAIR.format(pairs='nearest')} SELECT subject, rival, service FROM both_sides WHERE n_subject > 0 AND n_rival > 0",
    "multiset_recall": f"WITH {OFFERS}, {RIVALS}, {SERVICES}, {OF_PAIR.format(pairs='rivals')} SELECT subject, rival, round(sum(n_subject) FILTER (n_rival > 0) / sum(n_subject), 4) AS recall FROM both_sides GROUP BY 1, 2",
    "mode_per_key": f"WITH {OFFERS}, c AS (SELECT category, brand, count(*) AS n FROM offers GROUP BY 1, 2) SELECT category, brand FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, brand DESC) = 1",
    "cross_category_repeats": f"WITH {OFFERS} SELECT brand, count(DISTINCT category) - 1 AS repeats FROM offers GROUP BY 1",
}
