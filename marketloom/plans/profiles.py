"""Queries on entity profiles: dimensions, gaps, opportunities, benchmarks and focus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.operators import relational as R
from marketloom.plans.offers import OFFERS
from marketloom.plans.rankings import OF_PAIR, RIVALS, SERVICES, of_pair, rivals
from marketloom.sources.tables import entities, offers, table


def portfolio(s, d):
    return offers(s, d).groupBy("entity").agg(
        F.count("*").alias("n_offers"), F.count_distinct("category").alias("n_categories"),
        F.round(F.count("*") / F.count_distinct("category"), 4).alias("per_category"),
        F.round(100.0 * F.count_if("package") / F.count("*"), 2).alias("package_pct"),
    )


def pricing(s, d):
    return offers(s, d).groupBy("entity").agg(
        (F.max("price") - F.min("price")).alias("spread"), F.round(100.0 * F.count_if("promo") / F.count("*"), 2).alias("promo_pct"),
        F.expr("sum(price) div count(*)").alias("mean_price"),
    )


def dims_long(s, d):
    dims = portfolio(s, d).join(pricing(s, d), "entity")
    return dims.select(
        "entity", F.expr("stack(3, 'offers', cast(n_offers as double), 'spread', cast(spread as double), 'promo', promo_pct) AS (dimension, value)")
    )


def percentiles(s, d):
    return dims_long(s, d).groupBy("dimension").agg(*[X.pct_linear(F.col("value"), p).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)])


def position(s, d):
    """Mean percentile of an entity within its region, promo share counted the other way round."""
    dims = dims_long(s, d).join(entities(s, d).select(F.col("id").alias("entity"), "region"), "entity")
    rank = F.cume_dist().over(Window.partitionBy("region", "dimension").orderBy(F.when(F.col("dimension") == "promo", -F.col("value")).otherwise(F.col("value"))))
    return dims.withColumn("r", rank).groupBy("entity").agg(F.round(100 * F.avg("r"), 2).alias("position"))


def gaps(s, d):
    """Services that an entity lacks and its rivals have: the ten most popular of each entity."""
    o = offers(s, d).groupBy("entity", F.concat_ws("/", "brand", "category").alias("service")).agg(
        F.count("*").alias("n"), F.count_if("promo").alias("mentions"), F.sum("price").alias("price")
    )
    theirs = rivals(s, d).join(o, F.col("rival") == F.col("entity")).groupBy("subject", "service").agg(
        F.count("*").alias("peers"), F.sum("mentions").alias("mentions"), F.expr("sum(price) div sum(n)").alias("avg_price")
    )
    lacking = theirs.join(o.select(F.col("entity").alias("subject"), "service"), ["subject", "service"], "left_anti")
    g = lacking.withColumn("popularity", F.round(F.least(F.lit(999.99), F.col("peers") * (1 + F.col("mentions") / 100)), 4))
    return R.top_k(g, ["subject"], [F.desc("popularity"), F.col("service")], 10).select("subject", "service", "peers", "avg_price", "popularity")


def lift(s, d):
    """Share of a region's entities with a category over the share of all entities."""
    o = offers(s, d).select("entity", "category").distinct().join(entities(s, d).select(F.col("id").alias("entity"), "region"), "entity")
    n_region = entities(s, d).groupBy("region").agg(F.count("*").alias("n_region"))
    total = entities(s, d).agg(F.count("*").alias("n_all"))
    local = o.groupBy("region", "category").agg(F.count("*").alias("n_local")).join(n_region, "region")
    return local.join(o.groupBy("category").agg(F.count("*").alias("n_base")), "category").join(F.broadcast(total)).select(  # one row
        "region", "category", F.round((F.col("n_local") / F.col("n_region")) / (F.col("n_base") / F.col("n_all")), 4).alias("lift"))


def opportunities(s, d):
    o = offers(s, d)
    a = o.filter("promo").groupBy("category").agg(F.count("*").alias("n")).select(F.lit("promo").alias("kind"), "category", (F.col("n") * 2).alias("impact"))
    b = o.filter("package").groupBy("category").agg(F.count("*").alias("n")).select(F.lit("package").alias("kind"), "category", (F.col("n") * 3).alias("impact"))
    return a.unionByName(b).orderBy(F.desc("impact"), "kind", "category").limit(8)


def jaccard_pairs(s, d):
    """Entities and their rivals, by the services they share."""
    both = F.count_if((F.col("n_subject") > 0) & (F.col("n_rival") > 0))
    return of_pair(s, d, rivals(s, d)).groupBy("subject", "rival").agg(
        F.round(both / F.count("*"), 4).alias("jaccard"), F.round(both / F.count_if(F.col("n_subject") > 0), 4).alias("overlap")
    )


def benchmarks(s, d):
    """Median price for all, each region and each nation, where a scope has enough offers: grouping sets of counts by price."""
    o = offers(s, d).select("entity", "price").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), "s_nationkey"), "entity")
    o = o.join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    o = o.groupBy("n_regionkey", "n_name", "price").agg(F.count("*").alias("c"))
    g = o.groupingSets([[], ["n_regionkey"], ["n_regionkey", "n_name"]], "n_regionkey", "n_name").agg(
        F.percentile("price", F.lit(0.5), F.col("c")).alias("median"), F.sum("c").alias("n"), F.grouping("n_regionkey").alias("ga"), F.grouping("n_name").alias("gb"))
    scope = F.when(F.col("ga") == 1, "all").when(F.col("gb") == 1, "region").otherwise("nation")
    return g.filter("n >= 50").select(scope.alias("scope"), "n_regionkey", "n_name", "median", "n")


def focus(s, d):
    """Share of each category in an entity's weighted offers: 0.05 + 0.40 promo + 0.20 relative minutes."""
    top = F.max("minutes").over(Window.partitionBy("entity"))
    w = 0.05 + 0.40 * F.col("promo").cast("int") + 0.20 * F.col("minutes") / top
    return offers(s, d).withColumn("w", w)


def focus_distribution(s, d):
    g = focus(s, d).groupBy("entity", "category").agg(F.sum("w").alias("w"))
    g = g.withColumn("share", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("entity")), 6))
    return R.top_k(g, ["entity"], [F.desc("share"), F.col("category")], 5).select("entity", "category", "share")


def sparse_cosine(s, d):
    """Cosine of an entity's and each rival's category weights: joined on category, norms by entity."""
    g = focus(s, d).groupBy("entity", "category").agg(F.sum("w").alias("w"))
    norms = g.groupBy("entity").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    side = lambda p: g.join(norms, "entity").select(F.col("entity").alias(p), "category", (F.col("w") / F.col("norm")).alias(f"w_{p}"))
    pairs = rivals(s, d).join(side("subject"), "subject").join(side("rival"), ["rival", "category"])
    return pairs.groupBy("subject", "rival").agg(F.round(F.sum(F.col("w_subject") * F.col("w_rival")), 4).alias("cosine"))


QUERIES = {
    "dims_portfolio": portfolio, "dims_pricing": pricing, "dims_percentiles": percentiles, "market_position": position,
    "gap_missing_top10": gaps, "gap_lift": lift, "opportunities_top8": opportunities, "jaccard_sets": jaccard_pairs,
    "benchmarks_rollup": benchmarks, "focus_distribution": focus_distribution, "sparse_cosine": sparse_cosine,
}

_dims = f"""{OFFERS}, dims AS (SELECT entity, count(*) AS n_offers, count(DISTINCT category) AS n_categories, max(price) - min(price) AS spread,
  round(100.0 * count(*) FILTER (promo) / count(*), 2) AS promo_pct, round(100.0 * count(*) FILTER (package) / count(*), 2) AS package_pct, CAST(sum(price) // count(*) AS BIGINT) AS mean_price FROM offers GROUP BY 1),
long AS (SELECT entity, 'offers' AS dimension, CAST(n_offers AS DOUBLE) AS value FROM dims UNION ALL SELECT entity, 'spread', spread FROM dims UNION ALL SELECT entity, 'promo', promo_pct FROM dims)"""
_focus = f"{OFFERS}, f AS (SELECT *, 0.05 + 0.40 * CAST(promo AS INTEGER) + 0.20 * minutes / max(minutes) OVER (PARTITION BY entity) AS w FROM offers), g AS (SELECT entity, category, sum(w) AS w FROM f GROUP BY 1, 2)"
ORACLES = {
    "dims_portfolio": f"WITH {_dims} SELECT entity, n_offers, n_categories, round(n_offers / n_categories, 4) AS per_category, package_pct FROM dims",
    "dims_pricing": f"WITH {_dims} SELECT entity, spread, promo_pct, mean_price FROM dims",
    "dims_percentiles": f"WITH {_dims} SELECT dimension, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM long GROUP BY 1",
    "market_position": f"""WITH {_dims}, r AS (SELECT entity, cume_dist() OVER (PARTITION BY s_nationkey, dimension ORDER BY CASE WHEN dimension = 'promo' THEN -value ELSE value END) AS r FROM long JOIN supplier ON entity = s_suppkey)
      SELECT entity, round(100 * avg(r), 2) AS position FROM r GROUP BY 1""",
    "gap_missing_top10": f"""WITH {OFFERS}, {RIVALS}, o AS (SELECT entity, brand || '/' || category AS service, count(*) AS n, count(*) FILTER (promo) AS mentions, sum(price) AS price FROM offers GROUP BY 1, 2),
      t AS (SELECT subject, service, count(*) AS peers, sum(mentions) AS mentions, CAST(sum(price) // sum(n) AS BIGINT) AS avg_price FROM rivals JOIN o ON entity = rival GROUP BY 1, 2),
      g AS (SELECT *, round(least(999.99, peers * (1 + mentions / 100)), 4) AS popularity FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.entity = t.subject AND o.service = t.service))
      SELECT subject, service, peers, avg_price, popularity FROM g QUALIFY row_number() OVER (PARTITION BY subject ORDER BY popularity DESC, service) <= 10""",
    "gap_lift": f"""WITH {OFFERS}, o AS (SELECT DISTINCT entity, category, s_nationkey AS region FROM offers JOIN supplier ON entity = s_suppkey), r AS (SELECT s_nationkey AS region, count(*) AS n FROM supplier GROUP BY 1),
      l AS (SELECT region, category, count(*) AS n FROM o GROUP BY 1, 2), b AS (SELECT category, count(*) AS n FROM o GROUP BY 1)
      SELECT l.region, l.category, round((l.n / r.n) / (b.n / (SELECT count(*) FROM supplier)), 4) AS lift FROM l JOIN r USING (region) JOIN b ON b.category = l.category""",
    "opportunities_top8": f"""WITH {OFFERS} SELECT * FROM (SELECT 'promo' AS kind, category, count(*) * 2 AS impact FROM offers WHERE promo GROUP BY 2 UNION ALL SELECT 'package', category, count(*) * 3 FROM offers WHERE package GROUP BY 2)
      ORDER BY impact DESC, kind, category LIMIT 8""",
    "jaccard_sets": f"""WITH {OFFERS}, {RIVALS}, {SERVICES}, {OF_PAIR.format(pairs='rivals')} SELECT subject, rival, round(count(*) FILTER (n_subject > 0 AND n_rival > 0) / count(*), 4) AS jaccard,
      round(count(*) FILTER (n_subject > 0 AND n_rival > 0) / count(*) FILTER (n_subject > 0), 4) AS overlap FROM both_sides GROUP BY 1, 2""",
    "benchmarks_rollup": f"""WITH {OFFERS}, x AS (SELECT price, n_regionkey, n_name FROM offers JOIN supplier ON entity = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
      SELECT 'all' AS scope, CAST(NULL AS INTEGER) AS n_regionkey, CAST(NULL AS VARCHAR) AS n_name, quantile_cont(price, 0.5) AS median, count(*) AS n FROM x HAVING count(*) >= 50
      UNION ALL SELECT 'region', n_regionkey, NULL, quantile_cont(price, 0.5), count(*) FROM x GROUP BY n_regionkey HAVING count(*) >= 50
      UNION ALL SELECT 'nation', n_regionkey, n_name, quantile_cont(price, 0.5), count(*) FROM x GROUP BY n_regionkey, n_name HAVING count(*) >= 50""",
    "focus_distribution": f"WITH {_focus}, h AS (SELECT entity, category, round(w / sum(w) OVER (PARTITION BY entity), 6) AS share FROM g) SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY entity ORDER BY share DESC, category) <= 5",
    "sparse_cosine": f"""WITH {_focus}, {RIVALS}, n AS (SELECT entity, sqrt(sum(w * w)) AS norm FROM g GROUP BY 1) SELECT subject, rival, round(sum(a.w * b.w / m.norm / k.norm), 4) AS cosine
      FROM rivals JOIN g a ON a.entity = subject JOIN g b ON b.entity = rival AND a.category = b.category JOIN n m ON m.entity = subject JOIN n k ON k.entity = rival GROUP BY 1, 2""",
}
