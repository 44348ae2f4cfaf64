"""Queries on parsed fields, the older rival bucket and benchmarks with fallback scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.operators import relational as R
from marketloom.plans.offers import OFFERS
from marketloom.plans.rankings import SCORED, scored
from marketloom.sources.tables import offers, table

#: Least number of offers of each scope, widest last, and what holds where none has as many.
SCOPES = {"nation": (["category", "n_regionkey", "n_name"], 400), "region": (["category", "n_regionkey"], 2000), "all": (["category"], 10_000)}
CONSTANT = 5_000_000.0


def older_buckets(s, d):
    """The older bucket of each rival; reviews, ranks and a part of the score are made up."""
    score = X.composite_v1(F.col("same_region"), F.col("size_sim"), F.col("cat_sim"), F.col("price_sim"), F.pmod(F.col("rival"), F.lit(12)))
    rank = lambda c: F.pmod(F.col(c), F.lit(10)) / 10
    bucket = X.bucket_v1(score - (F.col("subject") + F.col("rival")) % 40, F.col("rival") * 37 % 100, rank("rival"), rank("subject"))
    return scored(s, d).select("subject", "rival", bucket.alias("bucket"))


def scoped_benchmarks(s, d):
    """Median price of each nation and category from the narrowest scope with enough offers, else a constant."""
    places = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    o = offers(s, d).select("entity", "category", "price").join(places.select(F.col("s_suppkey").alias("entity"), "n_regionkey", "n_name"), "entity")
    median = lambda key, least, scope: o.groupBy(*key).agg(
        F.struct(F.percentile("price", F.lit(0.5)).alias("median"), F.lit(scope).alias("scope")).alias("found"), F.count("*").alias("n")).filter(F.col("n") >= least)
    levels = [(median(key, least, scope), key) for scope, (key, least) in SCOPES.items()]
    out = R.fallback_join(o.select(*SCOPES["nation"][0]).distinct(), levels, "found")
    return out.select("category", "n_name", F.coalesce("found.median", F.lit(CONSTANT)).alias("median"), F.coalesce("found.scope", F.lit("constant")).alias("scope"))


def parsed(s, d):
    """Post code, megabytes, a safe ratio and the next due time of texts and numbers made from each customer's."""
    k = F.col("c_custkey").cast("long")
    address = F.when(k % 7 != 0, F.format_string("Main Street %d, %02d-%03d Town", k % 90, k % 100, k % 1000)).otherwise(F.lit("Main Street"))
    size = F.concat_ws(" ", (k % 900 + 1).cast("string"), F.get(F.array(*map(F.lit, ["kB", "MB", "GB", "pages"])), (k % 4).cast("int")))
    due = X.schedule_next(F.lit("2024-01-31 00:00:00").cast("timestamp"), (k % 3 + 1))
    return table(s, d, "customer").select(
        "c_custkey", X.postcode(address).alias("postcode"), F.round(X.size_mb(size), 6).alias("mb"), F.round(X.safe_ratio(F.col("c_acctbal"), k % 5 - 1), 4).alias("ratio"), due.alias("due")
    )


def price_range(s, d):
    return offers(s, d).groupBy("category").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.expr("sum(price) div count(*)").alias("mean"), F.count("*").alias("n"))


QUERIES = {"bucket_v1": older_buckets, "benchmark_fallback": scoped_benchmarks, "parsed_fields": parsed, "price_range": price_range}

_level = {scope: f"{scope[0]} AS (SELECT {', '.join(key)}, quantile_cont(price, 0.5) AS median FROM x GROUP BY ALL HAVING count(*) >= {least})" for scope, (key, least) in SCOPES.items()}
_v = X.BUCKET_V1
ORACLES = {
    "bucket_v1": f"""WITH {SCORED}, c AS (SELECT *, 30 * same_region + 20 * size_sim + 25 * cat_sim + 10 * price_sim - 2 * greatest(0, rival % 12 - 5) - (subject + rival) % 40 AS score FROM scored)
      SELECT subject, rival, CASE WHEN rival * 37 % 100 < {_v['few']} THEN 'new' WHEN score >= {_v['direct']} THEN 'direct' WHEN score >= {_v['cluster']} THEN 'cluster'
      WHEN (rival % 10) / 10 >= (subject % 10) / 10 + {_v['lead']}::DOUBLE THEN 'aspirational' END AS bucket FROM c""",
    "benchmark_fallback": f"""WITH {OFFERS}, x AS (SELECT category, n_regionkey, n_name, price FROM offers JOIN supplier ON entity = s_suppkey JOIN nation ON s_nationkey = n_nationkey), {', '.join(_level.values())}
      SELECT k.category, k.n_name, coalesce(n.median, r.median, a.median, {CONSTANT}) AS median, CASE WHEN n.median IS NOT NULL THEN 'nation' WHEN r.median IS NOT NULL THEN 'region' WHEN a.median IS NOT NULL THEN 'all' ELSE 'constant' END AS scope
      FROM (SELECT DISTINCT category, n_regionkey, n_name FROM x) k LEFT JOIN n USING (category, n_regionkey, n_name) LEFT JOIN r ON r.category = k.category AND r.n_regionkey = k.n_regionkey LEFT JOIN a ON a.category = k.category""",
    "parsed_fields": """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN format('{:02d}-{:03d}', c_custkey % 100, c_custkey % 1000) END AS postcode,
      round((c_custkey % 900 + 1) * CASE c_custkey % 4 WHEN 0 THEN 1.0::DOUBLE / 1024 WHEN 1 THEN 1.0 WHEN 2 THEN 1024.0 END, 6) AS mb, round(CASE WHEN c_custkey % 5 - 1 > 0 THEN c_acctbal / (c_custkey % 5 - 1) ELSE 0 END, 4) AS ratio,
      TIMESTAMP '2024-01-31 00:00:00' + CASE c_custkey % 3 WHEN 0 THEN INTERVAL 7 DAY WHEN 1 THEN INTERVAL 14 DAY ELSE INTERVAL 30 DAY END AS due FROM customer""",
    "price_range": f"WITH {OFFERS} SELECT category, min(price) AS low, max(price) AS high, CAST(sum(price) // count(*) AS BIGINT) AS mean, count(*) AS n FROM offers GROUP BY 1",
}
