"""Queries on price lists and reports: clean-up, rewrites, change lists, scores, references, work selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import cleanup as C
from marketloom.operators import records as R
from marketloom.sources.tables import entities, events, table

def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def noisy(s, d):
    """Parts with names as a careless writer would give them."""
    k = F.col("p_partkey")
    shout = F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    end = F.when(k % 4 == 0, "...").when(k % 4 == 1, " ✦").when(k % 4 == 2, "+extra").otherwise("")
    return table(s, d, "part").select(k.alias("id"), F.col("p_brand").alias("category"), F.concat(shout, end).alias("name"), "p_name", "p_size", "p_retailprice")


def changes(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").filter(k % 2 == 0).select(
        k.alias("id"), F.concat(F.lit('"'), F.col("p_name"), F.lit('" | 10 zł |')).alias("before"), F.lit("name").alias("type"),
        F.concat(F.lit("New "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string")).alias("after"),
    )


def rewritten(s, d):
    names = R.last_writes(changes(s, d), F.col("id")).filter("type = 'name'")
    return R.rewrite(noisy(s, d), names, "name").select("id", "name", "was_renamed")


def positional(s, d):
    old = noisy(s, d).select("category", "id", "name", "p_size")
    new = old.withColumns({"name": C.tidy_name(F.col("name")), "p_size": F.when(F.col("id") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))})
    return R.change_list(old, new, ["category", "id"], ["name", "p_size"])


def coverage(s, d):
    p = noisy(s, d)
    score = R.coverage_score(F.col("id") % 3 == 0, F.col("p_size") > 10, F.col("p_retailprice") > 950, F.col("p_size") % 2 == 0)
    return p.groupBy("category").agg(score.alias("score"))


def checks(s, d):
    p = table(s, d, "part")
    size = F.col("p_size")
    return p.select("p_partkey", *R.weighted_checks({
        "range": (2, size.between(5, 40)), "named": (3, F.length("p_name") > 8), "priced": (2, F.col("p_retailprice") < 1500), "typed": (1, F.col("p_type") != "SMALL"),
    })).withColumns({"score": F.round("score", 6), "failed": F.array_join("failed", ",")})


def references(s, d):
    ref = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.element_at(F.array(F.lit("nation"), F.lit("region"), F.lit("planet")), (i + 1).cast("int")).alias("type"), (F.col("s_suppkey") % 9 + i).cast("long").alias("id")))
    items = table(s, d, "supplier").select("s_suppkey", ref.alias("refs"))
    known = table(s, d, "nation").select(F.lit("nation").alias("type"), F.col("n_nationkey").cast("long").alias("id")).filter("id % 3 = 0").unionByName(
        table(s, d, "region").select(F.lit("region").alias("type"), F.col("r_regionkey").cast("long").alias("id"))
    )
    kept = R.existing_references(items, "refs", known, "s_suppkey")
    return kept.select("s_suppkey", F.array_join(F.transform("refs", lambda r: F.concat(r["type"], F.lit(":"), r["id"].cast("string"))), ",").alias("refs"))


def verified(s, d):
    p = table(s, d, "part").select("p_partkey", "p_name", "p_type")
    key = F.concat_ws("|", F.lower("p_name"), F.lower("p_type"))
    cache = p.filter("p_partkey % 7 = 0").select(key.alias("key"), (F.col("p_partkey") % 2 == 0).alias("comparable"))
    new = p.filter("p_partkey % 11 = 0").select(key.alias("key"), F.lit(False).alias("comparable"))
    return R.verified_pairs(p, cache, new, "p_name", "p_type").select("p_partkey", "comparable", "origin")


def retried(s, d):
    e = events(s, d)
    runs = e.select((F.col("user_id") % 40).alias("combo"), F.col("ts").alias("started"), F.col("ts").alias("finished"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), "event_id")
    runs = runs.filter(F.col("ts") <= now())
    return R.retries(runs, ["combo"], now(), limit=5).select("combo", "finished")


def quarters(s, d):
    e = entities(s, d)
    box = C.quadrants(F.col("lat") + 1, F.col("lng") + 2, F.col("lat") - 1, F.col("lng") - 2)
    return e.select("id", F.posexplode(box).alias("quarter", "q")).select("id", "quarter", *[F.round(f"q.{c}", 6).alias(c) for c in ("top", "right", "bottom", "left")])


def hourly(s, d):
    since = F.col("ts") >= now() - F.expr("INTERVAL 24 HOURS")
    is_ = lambda k: F.col("event_type") == k
    return events(s, d).filter(since & (F.col("ts") < now())).groupBy("user_id").agg(
        F.count("*").alias("total"), *[F.count_if(is_(k)).alias(f"n_{k}") for k in ("click", "view", "error")],
        F.count_if(is_("click") & (F.col("value") > 10)).alias("up"), F.count_if(is_("click") & (F.col("value") <= 10)).alias("down"),
    )


def nested(s, d):
    """Offers nested in categories, read back as counts and their first name."""
    p = noisy(s, d).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("id", "name", F.struct(F.col("p_size").alias("minutes")).alias("terms")))).alias("services"))
    return p.select("category", F.size("services").alias("n"), F.element_at("services", 1)["name"].alias("first"), F.aggregate("services", F.lit(0), lambda a, x: a + x["terms"]["minutes"]).alias("minutes"))


QUERIES = {
    "name_cleanup": lambda s, d: noisy(s, d).select("id", C.without_pictographs(C.sentence_case(C.tidy_name(F.col("name")))).alias("name")),
    "name_recovery": lambda s, d: noisy(s, d).select("id", C.full_name(F.concat(F.substring("p_name", 1, 8), F.lit("…"), F.substring("p_name", -1, 1)), F.array(F.lit("other"), F.col("p_name"))).alias("name")),
    "character_drift": lambda s, d: table(s, d, "part").select("p_partkey", F.round(C.character_drift(F.col("p_name"), F.col("p_type")), 6).alias("drift")),
    "token_match": lambda s, d: table(s, d, "part").select("p_partkey", C.share_tokens(F.col("p_name"), F.concat(F.lit("red blue "), F.lower("p_type"))).alias("match")),
    "labels_printed": lambda s, d: table(s, d, "part").select("p_partkey", C.counted(F.col("p_partkey"), "usługa", "usługi", "usług").alias("counted"), C.duration_label(F.col("p_size") * 5).alias("duration"), C.amount_label(F.col("p_size") / 4).alias("amount"), C.price_label(F.when(F.col("p_partkey") % 3 == 0, "od 50 zł"), F.col("p_partkey") * 100).alias("price")),
    "transformation_map": lambda s, d: R.last_writes(changes(s, d), F.col("id")),
    "price_list_rewrite": rewritten,
    "moved_repeats": lambda s, d: R.moved_repeats(table(s, d, "part"), F.col("p_name"), "p_brand", ["p_partkey"]).groupBy("p_brand").agg(F.count_if("repeated").alias("repeats")),
    "change_list": positional,
    "coverage_score": coverage,
    "truncation_issues": lambda s, d: noisy(s, d).filter(F.col("name").contains("...") | F.col("name").contains("…")).groupBy("category").agg(F.count("*").alias("n"), F.min_by("name", "id").alias("example")),
    "weighted_checks": checks,
    "existing_references": references,
    "verified_pairs": verified,
    "failed_run_retries": retried,
    "enrol_due": lambda s, d: R.enrol(table(s, d, "customer"), table(s, d, "orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", F.col("c_mktsegment") == "BUILDING", ["c_custkey"]).select("c_custkey", "c_name"),
    "alert_fan_out": lambda s, d: R.fan_out(table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n")), table(s, d, "customer").filter("c_acctbal > 9000").select("c_custkey", F.col("c_nationkey").alias("n")), "n", "s_suppkey", "c_custkey"),
    "box_quarters": quarters,
    "recent_event_summary": hourly,
    "nested_read_model": nested,
    "keyword_coverage": lambda s, d: R.keyword_coverage(table(s, d, "nation").select(F.lower("n_name").alias("keyword")).unionByName(table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct()), table(s, d, "part").select(F.col("p_name").alias("text"))),
}

_noisy = """noisy AS (SELECT p_partkey AS id, p_brand AS category, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END
|| CASE p_partkey % 4 WHEN 0 THEN '...' WHEN 1 THEN ' ✦' WHEN 2 THEN '+extra' ELSE '' END AS name, p_name, p_size, p_retailprice FROM part)"""
_tidy = "replace(trim(rtrim(trim({c}), '.')), '+extra', ' + extra')"
_spare = "trim(replace({c}, '✦', ''), ' -–—·:')"
_case = """CASE WHEN length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) > 5 AND length(regexp_replace({c}, '[^A-Z]', '', 'g')) > 0.6 * length(regexp_replace({c}, '[^A-Za-z]', '', 'g'))
THEN upper({c}[1]) || lower(substr({c}, 2)) ELSE {c} END"""
_clean = _spare.format(c="(" + _case.format(c="t") + ")")
_changes = "changes AS (SELECT p_partkey AS id, lower(p_name) AS key, 'name' AS type, 'New ' || p_name || ' ' || p_size AS after FROM part WHERE p_partkey % 2 = 0)"
_chars = "list_distinct(string_split(lower({c}), ''))"
_drift = f"len(list_intersect({_chars.format(c='p_name')}, {_chars.format(c='p_type')}))"
_recent = "ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-20'"
ORACLES = {
    "name_cleanup": f"WITH {_noisy}, t AS (SELECT id, {_tidy.format(c='name')} AS t FROM noisy) SELECT id, {_clean} AS name FROM t",
    "name_recovery": "SELECT p_partkey AS id, CASE WHEN length(trim(p_name[:8])) >= 8 AND length(p_name) > length(trim(p_name[:8])) + 1 THEN p_name ELSE p_name[:8] || '…' || p_name[-1:] END AS name FROM part",
    "character_drift": f"SELECT p_partkey, round(greatest(abs(length(p_name) - length(p_type)) / greatest(length(p_name), length(p_type)), 1 - {_drift} / (len({_chars.format(c='p_name')}) + len({_chars.format(c='p_type')}) - {_drift})), 6) AS drift FROM part",
    "token_match": "SELECT p_partkey, len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(['red', 'blue', lower(p_type)]))) >= 0.5 * least(len(list_distinct(string_split(p_name, ' '))), len(list_distinct(['red', 'blue', lower(p_type)]))) AS match FROM part",
    "labels_printed": """SELECT p_partkey, p_partkey || ' ' || CASE WHEN p_partkey = 1 THEN 'usługa' WHEN p_partkey % 10 IN (2, 3, 4) AND p_partkey % 100 NOT IN (12, 13, 14) THEN 'usługi' ELSE 'usług' END AS counted,
CASE WHEN p_size * 5 < 60 THEN p_size * 5 || 'min' WHEN p_size * 5 % 60 = 0 THEN p_size * 5 // 60 || 'h' ELSE p_size * 5 // 60 || 'h ' || p_size * 5 % 60 || 'min' END AS duration,
replace(rtrim(rtrim(CAST(CAST(p_size / 4 AS DECIMAL(18, 2)) AS VARCHAR), '0'), '.'), '.', ',') || ' zł' AS amount, CASE WHEN p_partkey % 3 = 0 THEN 'od 50 zł' ELSE p_partkey || ' zł' END AS price FROM part""",
    "transformation_map": f"WITH {_changes} SELECT key, type, arg_max(after, id) AS after FROM changes GROUP BY key, type",
    "price_list_rewrite": f"""WITH {_noisy}, {_changes}, m AS (SELECT key, arg_max(after, id) AS after FROM changes GROUP BY key),
t AS (SELECT n.id, n.name, {_tidy.format(c='coalesce(after, n.name)')} AS t FROM noisy n LEFT JOIN m ON lower(trim(n.name)) = key) SELECT id, {_clean} AS name, {_clean} <> name AS was_renamed FROM t""",
    "moved_repeats": "WITH t AS (SELECT p_brand, lag(p_brand) OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS l FROM part) SELECT p_brand, count(*) FILTER (l <> p_brand) AS repeats FROM t GROUP BY 1",
    "change_list": f"""WITH {_noisy} SELECT category, id, 'name' AS field, name AS before, {_tidy.format(c='name')} AS after FROM noisy WHERE name <> {_tidy.format(c='name')}
UNION ALL SELECT category, id, 'p_size', CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR) FROM noisy WHERE id % 5 = 0""",
    "coverage_score": f"""WITH {_noisy} SELECT category, CAST(round_even(40 * (count(*) FILTER (id % 3 = 0) / count(*)) + 20 * (count(*) FILTER (p_size > 10) / count(*)
+ count(*) FILTER (p_retailprice > 950) / count(*) + count(*) FILTER (p_size % 2 = 0) / count(*)), 0) AS INTEGER) AS score FROM noisy GROUP BY 1""",
    "truncation_issues": f"WITH {_noisy} SELECT category, count(*) AS n, arg_min(name, id) AS example FROM noisy WHERE contains(name, '...') GROUP BY 1",
    "weighted_checks": """WITH t AS (SELECT p_partkey, p_size BETWEEN 5 AND 40 AS a, length(p_name) > 8 AS b, p_retailprice < 1500 AS c, p_type <> 'SMALL' AS e FROM part),
g AS (SELECT *, (2 * a::INT + 3 * b::INT + 2 * c::INT + e::INT) / 8 AS s FROM t) SELECT p_partkey, round(s, 6) AS score, s >= 0.7 AS acceptable,
concat_ws(',', CASE WHEN NOT a THEN 'range' END, CASE WHEN NOT b THEN 'named' END, CASE WHEN NOT c THEN 'priced' END, CASE WHEN NOT e THEN 'typed' END) AS failed FROM g""",
    "existing_references": """WITH r AS (SELECT s_suppkey, i, ['nation', 'region', 'planet'][i + 1] AS type, s_suppkey % 9 + i AS id FROM supplier, range(3) x(i)),
k AS (SELECT 'nation' AS type, n_nationkey AS id FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'region', r_regionkey FROM region)
SELECT s_suppkey, string_agg(type || ':' || id, ',' ORDER BY i) AS refs FROM r SEMI JOIN k USING (type, id) GROUP BY 1""",
    "verified_pairs": """WITH p AS (SELECT p_partkey, lower(p_name) || '|' || lower(p_type) AS key FROM part), c AS (SELECT key, bool_or(p_partkey % 2 = 0) AS v FROM p WHERE p_partkey % 7 = 0 GROUP BY 1),
n AS (SELECT DISTINCT key, false AS w FROM p WHERE p_partkey % 11 = 0) SELECT p_partkey, coalesce(v, w, true) AS comparable, CASE WHEN v IS NOT NULL THEN 'cache' WHEN w IS NOT NULL THEN 'verdict' ELSE 'default' END AS origin
FROM p LEFT JOIN c USING (key) LEFT JOIN n USING (key)""",
    "failed_run_retries": """WITH l AS (SELECT user_id % 40 AS combo, arg_max(event_type, ts) AS k, max(ts) AS finished FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT combo, finished FROM l WHERE k = 'error' AND finished <= TIMESTAMP '2024-01-19 23:55:00' AND finished >= TIMESTAMP '2024-01-19' ORDER BY finished, combo LIMIT 5""",
    "enrol_due": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) ORDER BY c_custkey LIMIT 200",
    "alert_fan_out": "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9000",
    "box_quarters": """WITH e AS (SELECT s_suppkey AS id, 52 + ((s_suppkey * 7919) % 1000) / 5000 AS y, 21 + ((s_suppkey * 104729) % 1000) / 5000 AS x FROM supplier)
SELECT id, q::INT AS quarter, round(y + (q < 2)::INT, 6) AS top, round(x + 2 * (q % 2 = 0)::INT, 6) AS right, round(y - (q >= 2)::INT, 6) AS bottom, round(x - 2 * (q % 2 = 1)::INT, 6) AS left FROM e, range(4) r(q)""",
    "recent_event_summary": f"""SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'error') AS n_error,
count(*) FILTER (event_type = 'click' AND value > 10) AS up, count(*) FILTER (event_type = 'click' AND value <= 10) AS down FROM events WHERE {_recent} GROUP BY 1""",
    "nested_read_model": f"WITH {_noisy} SELECT category, CAST(count(*) AS INTEGER) AS n, arg_min(name, id) AS first, CAST(sum(p_size) AS INTEGER) AS minutes FROM noisy GROUP BY 1",
    "keyword_coverage": """WITH k AS (SELECT lower(n_name) AS k FROM nation UNION ALL SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part),
h AS (SELECT k, EXISTS (SELECT 1 FROM part WHERE contains(lower(p_name), k)) AS i FROM k) SELECT count(*) AS n, count(*) FILTER (i) AS present, round(100 * count(*) FILTER (i) / count(*), 2) AS coverage FROM h""",
}
