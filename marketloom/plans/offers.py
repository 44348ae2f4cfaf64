"""Queries on offers: filters, classifiers, percentiles and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.operators import relational as R
from marketloom.sources.tables import compile_filter, offers, table

#: SQL of the offers relation, shared by the oracles.
OFFERS = """offers AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_suppkey AS entity,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(l_quantity AS INTEGER) AS minutes,
         p_name AS name, p_brand AS brand, p_type AS category, l_linenumber = 7 AS package,
         l_discount >= 0.09 AS promo, l_shipdate AS ts
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
KEYS = ", ".join(KEY)
#: Statuses of the fixture's offers, by their minutes: three that are open to the flag, two that are not.
FLAG_STATUSES = ["verified", "method_targeted", "structured_direct", "subject_only", "duration_mismatch"]


def eligible(o):
    return (~F.col("package")) & (F.col("price") > 0) & F.col("minutes").between(5, 240)


ELIGIBLE = "NOT package AND price > 0 AND minutes BETWEEN 5 AND 240"


def with_deviation(spark, d):
    """Eligible offers with their category's median price and their deviation from it.

    Categories are few and large: medians are taken from counts by price and meet offers by part, so no task reads a category's offers.
    """
    o = offers(spark, d).filter(eligible(None))
    counts = o.groupBy("category", "price").agg(F.count("*").alias("n"))
    med = counts.groupBy("category").agg(F.percentile("price", F.lit(0.5), F.col("n")).alias("median"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category")).distinct().join(med, "category")
    return o.join(parts, ["l_partkey", "category"]).withColumn("deviation", F.round(100.0 * (F.col("price") - F.col("median")) / F.col("median"), 2))


DEVIATION = f"""{OFFERS}, med AS (SELECT category, quantile_cont(price, 0.5) AS median FROM offers WHERE {ELIGIBLE} GROUP BY 1),
dev AS (SELECT o.*, median, round(100.0 * (price - median) / median, 2) + 0.0 AS deviation FROM offers o JOIN med USING (category) WHERE {ELIGIBLE})"""


def classify(name, column):
    return lambda s, d: with_deviation(s, d).select(*KEY, "deviation", column().alias(name))


def agg(**columns):
    return lambda s, d: offers(s, d).groupBy("category").agg(*[f().alias(k) for k, f in columns.items()])


def by_position(name, position):
    return lambda s, d: R.at_positions(offers(s, d), ["category", "brand"], "price", {name: position}).drop("n")


def brand_means(s, d):
    return offers(s, d).groupBy("category", "brand").agg(F.sum("price").alias("t"), F.count("*").alias("n")).select(
        "category", "brand", F.expr("t div n").alias("v")
    )


def rank_of(name, test):
    """Share of the category's brands whose mean price passes the test against each brand's."""

    def run(s, d):
        a = brand_means(s, d)
        groups = a.groupBy("category").agg(F.collect_list("v").alias("all"))  # one value a brand
        j = a.join(groups, "category")
        hit = F.size(F.filter("all", lambda x: test(x, F.col("v"))))
        return j.select("category", "brand", F.round(100.0 * hit / F.size("all"), 4).alias(name))

    return run


MEANS = f"{OFFERS}, m AS (SELECT category, brand, CAST(sum(price) // count(*) AS BIGINT) AS v FROM offers GROUP BY 1, 2)"


def rank_linear(s, d):
    a = brand_means(s, d)
    q = a.groupBy("category").agg(F.percentile("v", F.lit(0.25)).alias("p25"), F.percentile("v", F.lit(0.75)).alias("p75"))
    return a.join(q, "category").select("category", "brand", F.round(X.rank_linear_map(F.col("v"), F.col("p25"), F.col("p75")), 4).alias("rank"))


FILTER = {
    "and": [
        {"column": "c_acctbal", "op": "gt", "value": 100.0},
        {"or": [{"column": "c_mktsegment", "op": "in", "value": ["BUILDING", "MACHINERY"]}, {"column": "c_nationkey", "op": "lt", "value": 5}]},
        {"not": {"column": "c_name", "op": "ilike", "value": "%9"}},
    ]
}

QUERIES = {
    "eligible_offers": lambda s, d: offers(s, d).filter(eligible(None)).select(*KEY, "price", "minutes"),
    "promo_filter": lambda s, d: offers(s, d).filter("promo").groupBy("entity").agg(F.count("*").alias("n_promos"), F.min("price").alias("lowest")),
    "tolerance_filter": lambda s, d: offers(s, d).withColumn("other", F.when(F.col("minutes") % 7 != 0, F.col("l_linenumber") * 8)).filter(
        F.coalesce(F.abs(F.col("minutes") - F.col("other")) <= 20, F.lit(True))).select(*KEY, "minutes", "other"),
    "filter_dsl": lambda s, d: table(s, d, "customer").filter(compile_filter(FILTER, {"c_acctbal", "c_mktsegment", "c_nationkey", "c_name"})),
    "action_a": classify("action", lambda: X.action_a(F.col("deviation"))),
    "action_b": classify("action", lambda: X.action_b(F.col("deviation"))),
    "action_c": classify("action", lambda: X.action_c(F.col("deviation"))),
    "severity": classify("severity", lambda: X.severity(F.col("deviation"))),
    "duration_bucket": lambda s, d: offers(s, d).groupBy(X.duration_bucket(F.nullif(F.col("minutes") * 3, F.lit(21))).alias("bucket")).agg(F.count("*").alias("n")),
    "verify_status": classify("status", lambda: X.verify_status(F.col("package"), F.col("minutes") / 25, F.col("minutes") / 20, F.col("deviation"))),
    "extreme_flag": classify("flag", lambda: X.extreme_flag(F.get(F.array(*map(F.lit, FLAG_STATUSES)), F.col("minutes") % len(FLAG_STATUSES)), F.col("deviation"), X.OPEN_STATUSES)),
    "package_verdict": classify("verdict", lambda: X.package_verdict(F.col("deviation"))),
    "pct_linear": agg(p25=lambda: X.pct_linear(F.col("price"), 0.25), p50=lambda: X.pct_linear(F.col("price"), 0.5), p75=lambda: X.pct_linear(F.col("price"), 0.75)),
    "pct_rounded": agg(p25=lambda: X.pct_rounded(F.col("price"), 0.25), p75=lambda: X.pct_rounded(F.col("price"), 0.75)),
    "median_mid": agg(median=lambda: F.median("price")),
    "median_low": agg(median=lambda: F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price)").cast("long")),
    "median_upper": by_position("median", X.upper_position()),
    "pct_floor_index": by_position("p75", X.floor_position(0.75)),
    "rank_leq": rank_of("rank", lambda x, v: x <= v),
    "rank_lt": rank_of("rank", lambda x, v: x < v),
    "rank_linear_map": rank_linear,
    "sufficiency": lambda s, d: offers(s, d).groupBy("category", "brand").agg(F.count_distinct("entity").alias("n")).select(
        "category", "brand", X.sufficiency(F.col("n")).alias("status"), F.round(X.confidence(F.col("n")), 4).alias("confidence")),
    "count_verbs": lambda s, d: offers(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("promo") & (F.col("minutes") >= 25)).alias("n_long_promos")),
    "range_page": lambda s, d: table(s, d, "customer").orderBy("c_custkey").offset(20).limit(30).select("c_custkey", "c_name"),
}

_case_a = "CASE WHEN deviation < -15 THEN 'raise' WHEN deviation > 20 THEN 'lower' ELSE 'hold' END"
_case_b = "CASE WHEN abs(deviation) < 10 THEN 'hold' WHEN deviation < 0 THEN 'raise' ELSE 'lower' END"
_case_c = "CASE WHEN deviation IS NULL OR abs(deviation) <= 8 THEN 'hold' WHEN deviation < 0 THEN 'raise' ELSE 'lower' END"
_verify = """CASE WHEN deviation = 0 THEN 'verified' WHEN package THEN 'package_mismatch' WHEN minutes / 25 < 0.80 THEN 'low_name_similarity' WHEN minutes / 20 > 2 THEN 'duration_mismatch'
 ELSE 'extreme_outlier' END"""


def _classified(case: str, name: str) -> str:
    return f"WITH {DEVIATION} SELECT {KEYS}, deviation, {case} AS {name} FROM dev"


ORACLES = {
    "eligible_offers": f"WITH {OFFERS} SELECT {KEYS}, price, minutes FROM offers WHERE {ELIGIBLE}",
    "promo_filter": f"WITH {OFFERS} SELECT entity, count(*) AS n_promos, min(price) AS lowest FROM offers WHERE promo GROUP BY 1",
    "tolerance_filter": f"""WITH {OFFERS}, x AS (SELECT *, CASE WHEN minutes % 7 <> 0 THEN l_linenumber * 8 END AS other FROM offers)
      SELECT {KEYS}, minutes, other FROM x WHERE coalesce(abs(minutes - other) <= 20, true)""",
    "filter_dsl": """SELECT * FROM customer WHERE c_acctbal > 100 AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey < 5)
      AND NOT (c_name ILIKE '%9')""",
    "action_a": _classified(_case_a, "action"),
    "action_b": _classified(_case_b, "action"),
    "action_c": _classified(_case_c, "action"),
    "severity": _classified("CASE WHEN deviation > 20 THEN 'critical' WHEN abs(deviation) >= 5 THEN 'warning' ELSE 'info' END", "severity"),
    "duration_bucket": f"""WITH {OFFERS}, x AS (SELECT nullif(minutes * 3, 21) AS m FROM offers)
      SELECT CASE WHEN m IS NULL THEN 'unknown' WHEN m <= 30 THEN 'short' WHEN m <= 90 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM x GROUP BY 1""",
    "verify_status": _classified(_verify, "status"),
    "extreme_flag": _classified(f"CASE WHEN minutes % 5 < 3 AND abs(deviation) > 150 THEN 'extreme_outlier' ELSE {FLAG_STATUSES}[minutes % 5 + 1] END", "flag"),
    "package_verdict": _classified("CASE WHEN deviation >= 5 THEN 'fair' WHEN deviation <= -50 THEN 'no_match' WHEN deviation <= -5 THEN 'overpriced' ELSE 'fake' END", "verdict"),
    "pct_linear": f"WITH {OFFERS} SELECT category, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.75) AS p75 FROM offers GROUP BY 1",
    "pct_rounded": f"WITH {OFFERS} SELECT category, CAST(round_even(quantile_cont(price, 0.25), 0) AS BIGINT) AS p25, CAST(round_even(quantile_cont(price, 0.75), 0) AS BIGINT) AS p75 FROM offers GROUP BY 1",
    "median_mid": f"WITH {OFFERS} SELECT category, median(price) AS median FROM offers GROUP BY 1",
    "median_low": f"WITH {OFFERS} SELECT category, quantile_disc(price, 0.5) AS median FROM offers GROUP BY 1",
    "median_upper": f"WITH {OFFERS}, g AS (SELECT category, brand, list_sort(list(price)) AS v FROM offers GROUP BY 1, 2) SELECT category, brand, v[len(v) // 2 + 1] AS median FROM g",
    "pct_floor_index": f"WITH {OFFERS}, g AS (SELECT category, brand, list_sort(list(price)) AS v FROM offers GROUP BY 1, 2) SELECT category, brand, v[CAST(floor(0.75 * (len(v) - 1)) AS BIGINT) + 1] AS p75 FROM g",
    "rank_leq": f"WITH {MEANS} SELECT a.category, a.brand, round(100.0 * count(*) FILTER (b.v <= a.v) / count(*), 4) AS rank FROM m a JOIN m b USING (category) GROUP BY 1, 2",
    "rank_lt": f"WITH {MEANS} SELECT a.category, a.brand, round(100.0 * count(*) FILTER (b.v < a.v) / count(*), 4) AS rank FROM m a JOIN m b USING (category) GROUP BY 1, 2",
    "rank_linear_map": f"""WITH {MEANS}, q AS (SELECT category, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75 FROM m GROUP BY 1)
      SELECT category, brand, CASE WHEN p75 > p25 THEN round(greatest(0.0, least(100.0, 25 + 50 * (v - p25) / (p75 - p25))), 4) END AS rank FROM m JOIN q USING (category)""",
    "sufficiency": f"""WITH {OFFERS}, g AS (SELECT category, brand, count(DISTINCT entity) AS n FROM offers GROUP BY 1, 2)
      SELECT category, brand, CASE WHEN n >= 5 THEN 'full' WHEN n >= 3 THEN 'thin' ELSE 'insufficient' END AS status, round(least(1.0, n / 5), 4) AS confidence FROM g""",
    "count_verbs": f"WITH {OFFERS} SELECT count(*) AS n, count(*) FILTER (promo AND minutes >= 25) AS n_long_promos FROM offers",
    "range_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 20",
}
