"""Queries on scores, confidences, assignments, bundles, hierarchies and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.functions import scores as S
from marketloom.operators import decisions as D
from marketloom.operators import pricing as P
from marketloom.operators import relational as R
from marketloom.operators.staging import staged
from marketloom.plans.joins import distance
from marketloom.plans.offers import OFFERS
from marketloom.plans.pricing import DEALT, OFFER, SAMPLES, SERVICE, VOTES, area, paired, pairs, sides, voted
from marketloom.plans.pricing import named as named_rows
from marketloom.plans.rankings import RIVALS, SCORED, rivals, rivals_at, scored
from marketloom.sources.tables import entities, events, lines, offers, table, vectors

#: Price texts of the fixture, by part number.
PRICES = ["50 zł", "od 50 zł", "od50", "50 - 80 zł", "from 50", "50–80 zł", "50,00 zł+"]


def price_text(part):
    return F.get(F.array(*map(F.lit, PRICES)), part % len(PRICES))


_price_text = f"{PRICES}[p_partkey % {len(PRICES)} + 1]"
_fixed = f"NOT regexp_matches(lower({_price_text}), '^od(\\s|\\d)|od |from | - |–')"


def brand_stats(s, d):
    p = table(s, d, "part")
    return p.groupBy("p_brand").agg(
        F.count("*").alias("total"), F.count_if(F.length("p_name") >= 10).alias("described"), F.count_if(F.expr("p_size > 10")).alias("timed"),
        F.count_if(S.fixed_price(price_text(F.col("p_partkey").cast("int")))).alias("fixed"),
    )


_stats = f"stats AS (SELECT p_brand, count(*) AS total, count(*) FILTER (length(p_name) >= 10) AS described, count(*) FILTER (p_size > 10) AS timed, count(*) FILTER ({_fixed}) AS fixed FROM part GROUP BY 1)"
_complete = "CAST(least(15, round_even(6.0 * described / total + 5.0 * timed / total + 4.0 * fixed / total, 0)) AS INTEGER)"


def completeness(s, d):
    return brand_stats(s, d).select("p_brand", S.completeness(F.col("described"), F.col("timed"), F.col("fixed"), F.col("total")).alias("points"))


def capped(s, d):
    x = brand_stats(s, d)
    poor, loose, untimed = ((F.col("total") - F.col(c)) / F.col("total") for c in ("described", "fixed", "timed"))
    critical = (loose > 0.72).cast("int") + (loose > 0.71).cast("int") + (untimed > 0.2).cast("int")
    major = (loose > 0.7).cast("int") + (poor > 0.0).cast("int")
    minor = (untimed > 0.1).cast("int")
    return x.select("p_brand", X.score_cap(F.round(99 - 60 * untimed).cast("int"), critical, major, critical + major + minor).alias("score"))


def seo(s, d):
    c = table(s, d, "customer").filter("c_acctbal < 0").groupBy("c_nationkey").agg(*[F.count_if(F.col("c_mktsegment") == x).alias(x.lower()) for x in ("BUILDING", "MACHINERY", "FURNITURE")])
    return c.select("c_nationkey", S.seo(F.col("building"), F.col("machinery"), F.col("furniture")).alias("points"))


def ux(s, d):
    per = table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("p_name")).alias("repeated"))
    b = per.groupBy("p_brand").agg(
        (F.lit(6) - F.count("*")).alias("empty"), F.count_if(F.expr("n > 20")).alias("over"), F.count_if(F.expr("n < 10")).alias("under"), F.sum("repeated").alias("repeated"), F.max("n").alias("most"), F.min("n").alias("least")
    )
    return b.select("p_brand", S.ux(*[F.col(c) for c in ("empty", "over", "under", "repeated", "most", "least")]).alias("points"))


def data_quality(s, d):
    text = F.coalesce("text", F.lit(""))
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(text.rlike(rx)).alias(k) for k, rx in S.TEXT_CHECKS.items()])


def alias_confidence(s, d):
    p = table(s, d, "part")
    family = F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand"))
    canonical = F.when(F.col("p_partkey") % 3 == 0, F.translate("p_name", " ", "_")).otherwise(F.col("p_type"))
    return p.select("p_partkey", S.alias_confidence(family, canonical, F.substring_index("p_name", " ", -1)).alias("confidence"))


NAMES = """SELECT p_partkey % 400 AS cluster, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'fam' END AS family,
  'fam' || CASE WHEN p_partkey % 400 % 4 = 0 THEN ' x_peel' WHEN p_partkey % 400 % 4 = 1 THEN ' xpeel' || CAST(p_partkey // 400 % 3 AS VARCHAR) WHEN p_partkey % 400 % 4 = 2 THEN CASE p_partkey // 400 % 2 WHEN 0 THEN ' x-peel' ELSE ' X peel' END ELSE p_name END AS name FROM part"""


def named(s, d):
    k, part = F.col("p_partkey") % 400, F.floor(F.col("p_partkey") / 400)
    tail = F.when(k % 4 == 0, " x_peel").when(k % 4 == 1, F.concat(F.lit(" xpeel"), (part % 3).cast("string")))
    tail = tail.when(k % 4 == 2, F.when(part % 2 == 0, " x-peel").otherwise(" X peel")).otherwise(F.col("p_name"))
    return table(s, d, "part").select(k.alias("cluster"), F.when(F.col("p_partkey") % 11 != 0, "fam").alias("family"), F.concat(F.lit("fam"), tail).alias("name"))


def shown_first(s, d):
    """Rivals as they are shown: five near ones of the two close buckets, then the others by their score."""
    x = scored(s, d, rivals_at(s, d))
    bucket = F.when(F.col("price_sim") >= 0.97, "direct").when(F.col("size_sim") >= 0.95, "cluster").otherwise("new")
    place = S.display_rank(bucket, F.col("m"), [F.desc("price_sim"), F.col("rival")], ["subject"], 2)
    return x.withColumn("bucket", bucket).select("subject", "rival", "bucket", place.alias("place"))


def by_name(s, d):
    """One match of each service. Offers are ranked by id within what is compared, so that the rank decides ties and leads back to the id."""
    a, b = sides(s, d, ["minutes", "name", *OFFER])
    b = b.withColumn("o_id", F.concat_ws("/", "o_l_orderkey", "o_l_partkey", "o_entity", "o_l_linenumber", "o_price"))
    b = b.withColumn("o_rank", F.row_number().over(Window.partitionBy(*DEALT).orderBy("o_id")))
    best = D.best_ranked(P.near(paired(a, b)), SERVICE, F.col("s_name") == F.col("o_name"), F.col("similarity"), F.col("o_rank"))
    # Bounds instead of an equality: both sides are dealt out by the other columns already and stay where they are.
    x = best.join(b.select(*DEALT, "o_id", "o_rank"), DEALT).filter((F.col("o_rank") >= F.col("rank")) & (F.col("o_rank") <= F.col("rank")))
    return named_rows(x.select(*SERVICE, "o_id", "by_name", "similarity"))


NEUTRAL = {"strong": r"promo", "weak": ["hot gear"], "roots": ["small", "red"], "domain": r"\bbolt|\bgear", "filler": r"\b(ring|widget)\b"}


def neutral(s, d):
    kind = S.neutral_category(F.concat_ws(" ", F.when(F.col("p_size") < 5, "promo"), "p_name"), **NEUTRAL)
    return table(s, d, "part").groupBy("p_name", "p_size").agg(F.min(kind).alias("kind"))


_kind = """CASE WHEN p_size < 5 OR p_name = 'hot gear' THEN 'event' WHEN contains(p_name, 'small') THEN CASE WHEN NOT regexp_matches(regexp_replace(p_name, 'small\\w*', ' ', 'g'), '\\bbolt|\\bgear') THEN 'service' END
  WHEN contains(p_name, 'red') THEN CASE WHEN NOT regexp_matches(regexp_replace(p_name, 'red\\w*', ' ', 'g'), '\\bbolt|\\bgear') THEN 'service' END END"""


def areas(s, d):
    """Whether the areas of two names agree, with the number of pairs that have these names."""
    x = P.near(pairs(s, d, ["minutes", "name"])).groupBy("s_name", "o_name").agg(F.count("*").alias("n"))
    found = [area(X.word_set(F.col(c))) for c in ("s_name", "o_name")]
    return x.withColumn("compatible", S.areas_compatible(*found))


def similar_enough(s, d):
    v = vectors(s, d)
    refs = R.top_k(v, ["entity"], [F.col("id")], 2)
    return D.similar_enough(v.withColumn("vector", F.when(F.col("id") % 13 != 0, F.col("vector"))), refs, "entity", 0.05)


def unique_vectors(s, d):
    v = vectors(s, d).withColumn("region", F.col("entity") % 5)
    own = v.withColumn("vector", F.when(F.col("id") % 17 != 0, F.col("vector")))
    return D.verified_unique(own, v, ["label", "region"], 0.3)


def hybrid(s, d):
    """Distinct names of parts against names of types and things, each with the vector of its first part's number."""
    p = table(s, d, "part")
    v = vectors(s, d).select("id", "vector")
    names = p.groupBy("p_name").agg(F.min("p_partkey").alias("k")).withColumn("vid", F.col("k") % 500)
    canon = p.groupBy("p_type", F.substring_index("p_name", " ", -1).alias("thing")).agg(F.min("p_partkey").alias("k"))
    canon = canon.select(F.concat_ws(" ", "p_type", "thing").alias("match"), (F.col("k") % 500).alias("vid"))
    vec = v.select(F.col("id").alias("vid"), "vector")
    a = names.join(vec, "vid").select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), "vector")
    return D.hybrid_match(a, canon.join(vec, "vid").select("match", F.col("match").alias("canonical"), "vector"), floor=0.2)


def methods(s, d):
    """Methods of each entity (the thing that a name ends in): offers, distinct names, three sample names."""
    m = F.substring_index("name", " ", -1)
    per = offers(s, d).groupBy("entity", m.alias("method"), "name").agg(F.count("*").alias("n"))
    first = R.top_k(per, ["entity", "method"], [F.desc("n"), F.col("name")], 3, "place").groupBy("entity", "method").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("samples"))
    return per.groupBy("entity", "method").agg(F.sum("n").alias("n"), F.count("*").alias("names")).join(first, ["entity", "method"])


def offering(s, d):
    """Entities that offer some methods: most methods first, then most offers, then the nearest; twenty of them."""
    o = offers(s, d).withColumn("method", F.substring_index("name", " ", -1)).filter(F.col("method").isin("ring", "bolt"))
    per = o.groupBy(F.col("entity").alias("id")).agg(F.count_distinct("method").alias("methods"), F.count("*").alias("n"))
    m = F.round(X.haversine_m(F.lit(52.1), F.lit(21.1), F.col("lat"), F.col("lng")), 3)
    return per.join(entities(s, d), "id").withColumn("m", m).orderBy(F.desc("methods"), F.desc("n"), "m", "id").limit(20).select("id", "methods", "n")


def method_prices(s, d):
    """Prices of a method among the rivals: three samples of two entities at least."""
    near = staged(rivals(s, d), "rivals")
    o = lines(s, d).filter("l_linenumber <> 7").select("l_partkey", "entity", "price")
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring_index("p_name", " ", -1).alias("method"))
    o = o.join(near.select(F.col("rival").alias("entity")).distinct(), "entity", "left_semi")
    return D.prices_among(o.join(p, "l_partkey"), near).filter("n >= 3 AND rivals >= 2")


def price_events(s, d):
    """Rivals' services whose mean price moved by a tenth from one year to the next, for each entity beside them."""
    key = ["entity", "brand", "category"]
    y = F.year("ts")
    mean = lambda year: F.expr(f"sum(CASE WHEN year(ts) = {year} THEN price END) div count(CASE WHEN year(ts) = {year} THEN 1 END)")
    x = offers(s, d).filter(y.isin(1995, 1996)).groupBy(*key).agg(mean(1995).alias("before"), mean(1996).alias("after"))
    moved = x.withColumn("pct", F.round(100.0 * (F.col("after") - F.col("before")) / F.col("before"), 2)).filter("abs(pct) >= 10")
    return rivals(s, d).join(moved, F.col("rival") == F.col("entity")).groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.expr("pct > 0")).alias("raised"), F.min("pct").alias("lowest"))


def signals(s, d):
    """Changes between an user's days: over five more clicks, a mean value down by more than a tenth, a purchase begun or ended."""
    day = events(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.avg(F.round("value", 2).cast("decimal(12,2)")).cast("double").alias("mean"), F.max((F.col("event_type") == "purchase").cast("int")).alias("buys")
    )
    w = Window.partitionBy("user_id").orderBy("day")
    x = day.select("user_id", "day", (F.col("clicks") - F.lag("clicks").over(w)).alias("c"), F.round(F.col("mean") - F.lag("mean").over(w), 3).alias("m"), (F.col("buys") - F.lag("buys").over(w)).alias("b"))
    return x.groupBy("user_id").agg(F.count_if(F.expr("c > 1")).alias("spikes"), F.count_if(F.expr("m < -0.1")).alias("drops"), F.count_if(F.expr("b = 1")).alias("begun"), F.count_if(F.expr("b = -1")).alias("ended"))


VERSIONS = ["o_orderstatus", "o_orderpriority"]


def canonical(s, d):
    """JSON with keys in any order and volatile ones at two depths, in its canonical form and as a hash."""
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{"z": {"scraped_at": 1, "b":'), k, F.lit(', "a": [ {"scraped_at": 2, "v": null} ]}, "scraped_at": "x", "k":'), k, F.lit("}"))
    return events(s, d).select("event_id", D.canonical_json(["scraped_at"])(raw).alias("doc")).withColumn("content_hash", F.sha2("doc", 256))


def reverse(s, d):
    x = D.reverse_changes(table(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], VERSIONS)
    return x.select("o_orderkey", F.size("changes").cast("long").alias("n"), F.array_join(F.transform("changes", lambda c: F.concat_ws("=", c["field"], c["value"])), ";").alias("patch"))


PROMOS = ['{{"rate": 10, "price": {{"price": {p}}}}}', '{{"promotion": {{"price": {p}, "discount_amount": 15}}}}', '{{"variants": [{{"promotion": {{"price": {p}}}}}]}}', '{{"rate": 5}}']


def promos(s, d):
    p = (F.col("p_partkey") % 90 + 5).cast("string")
    docs = [F.concat(F.lit(t.split("{p}")[0].replace("{{", "{").replace("}}", "}")), p, F.lit(t.split("{p}")[1].replace("{{", "{").replace("}}", "}"))) if "{p}" in t else F.lit(t.replace("{{", "{").replace("}}", "}")) for t in PROMOS]
    doc = F.get(F.array(*docs), (F.col("p_partkey") % 4).cast("int"))
    price, pct = S.promotion(doc, F.lit(10000))
    return table(s, d, "part").select("p_partkey", price.alias("promo_price"), pct.alias("discount_pct"))


def fallback(s, d):
    """A column, else the same field of the raw document."""
    return events(s, d).select("event_id", F.coalesce(F.when(F.col("value") > 10, F.floor("value")), F.get_json_object("props", "$.k").try_cast("long")).alias("k"))


def json_totals(s, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events(s, d).groupBy("event_type").agg(F.count(k).alias("n"), F.min(k).alias("low"), F.max(k).alias("high"), F.median(k).alias("median"))


def hierarchy(s, d):
    """All places under the first nine, in a hierarchy of suppliers by number."""
    k = F.col("s_suppkey")
    edges = table(s, d, "supplier").filter(k > 1).select(F.floor(k / 3).alias("parent"), k.alias("child"))
    return D.descendants(s, edges, s.range(1, 10))


def packages(s, d):
    label = lambda i: F.when(F.col("p_partkey") % (i + 2) == 0, F.concat((F.col("p_partkey") % 5 + 2).cast("string"), F.lit("x zabieg"))).when(F.col("p_partkey") % (i + 3) == 0, "").otherwise("zabieg")
    labels = F.array(*[label(i) for i in range(2)])
    return table(s, d, "part").select("p_partkey", S.all_packages(X.is_package(F.col("p_name")), labels, X.is_package).alias("package"))


def union_key(s, d):
    """Orders meet customers by the raw id where there is one, else by id, else by a synthetic key: one key with its kind."""
    o = table(s, d, "orders")
    raw, id_, nation = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")), F.when(F.col("o_custkey") % 3 == 1, F.col("o_custkey")), F.col("o_custkey") % 25
    tagged = lambda a, b, c: F.coalesce(F.concat(F.lit("raw:"), a.cast("string")), F.concat(F.lit("id:"), b.cast("string")), F.concat(F.lit("syn:"), c.cast("string")))
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    right = c.select(F.explode(F.array(F.concat(F.lit("raw:"), k.cast("string")), F.concat(F.lit("id:"), k.cast("string")))).alias("key"), "c_name").unionByName(
        c.groupBy(F.concat(F.lit("syn:"), (k % 25).cast("string")).alias("key")).agg(F.min("c_name").alias("c_name")))
    return o.select("o_orderkey", tagged(raw, id_, nation).alias("key")).join(right, "key", "left").select("o_orderkey", "c_name")


def bundles(s, d):
    own = offers(s, d).groupBy("entity").agg(F.expr("sum(price) div count(*)").alias("value"))
    cached = entities(s, d).filter("id % 3 = 0").select(F.col("id").alias("entity"), (F.col("id") * 100).alias("value"))
    return D.cached_or_computed(entities(s, d).select(F.col("id").alias("entity")), cached, own, "entity", "value")


def due_bundles(s, d):
    last = table(s, d, "orders").filter("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("computed_at"))
    return table(s, d, "customer").select("c_custkey").join(last, "c_custkey", "left").orderBy(F.col("computed_at").asc_nulls_first(), "c_custkey").limit(500)


def fixed_strictness(s, d):
    v = voted(s, d).withColumn("kept", P.matches(F.lit(0.5))).withColumn("pure", P.matches(F.lit(0.6)))
    return named_rows(v.groupBy(*SERVICE).agg(
        F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), *[F.count_if(F.col(c) == -1).alias(f"{c}_against") for c in VOTES],
        F.round(F.try_divide(F.count_if(F.col("kept") & F.col("pure")), F.count_if("kept")), 4).alias("purity_kept"), F.round(F.count_if("pure") / F.count("*"), 4).alias("purity_in"),
    ))


def context(s, d):
    x = P.near(pairs(s, d, ["minutes", "words"])).withColumn("vote_category", P.category_vote(F.col("s_words"), F.col("o_words")))
    weight = F.when(F.col("vote_category") == 1, 1.0).when(F.col("vote_category") == 0, 0.5).otherwise(0.0)
    return named_rows(D.layered_count(x, SERVICE, weight, 0.5))


def ended(s, d):
    """Services of 1995 that were gone in 1996 and that the history lacks (it knows those of half of the brands)."""
    key = ["entity", "brand", "category"]
    o = offers(s, d).select(*key, "ts", F.year("ts").alias("y"))
    gone = o.filter("y = 1995").groupBy(*key).agg(F.max("ts").alias("ended_at")).join(o.filter("y = 1996").select(*key), key, "left_anti")
    known = gone.filter(F.length("brand") == 8)
    return gone.join(known.select(*key), key, "left_anti")


def refreshed(s, d):
    """Newest and former metric of each member, where it changed by over five per cent; one row a member."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    x = table(s, d, "orders").withColumns({"rn": F.row_number().over(w), "before": F.lead("o_totalprice").over(w)}).filter("rn = 1 AND before > 0")
    pct = F.round(100 * (F.col("o_totalprice") - F.col("before")) / F.col("before"), 1)
    return x.withColumn("pct", pct).filter("abs(pct) > 5").select("o_custkey", "o_orderkey", "pct")


def verified_keys(s, d):
    """Distinct brands' categories of an entity with a promotion, in grades of ten, five and three."""
    n = F.count_distinct(F.when(F.col("promo"), F.struct("brand", "category")))
    g = offers(s, d).groupBy("entity").agg(n.alias("n"))
    return g.select("entity", "n", F.when(F.col("n") >= 60, "many").when(F.col("n") >= 50, "some").when(F.col("n") >= 3, "few").otherwise("none").alias("grade"))


def canonical_means(s, d):
    canon = F.when(F.col("l_partkey") % 4 != 0, F.col("category"))
    return offers(s, d).withColumn("canon", canon).filter("canon IS NOT NULL").groupBy("entity", "canon").agg(F.expr("sum(price) div count(price)").alias("mean"))


def mean_or_null(s, d):
    dear = F.when(F.col("price") > 9_500_000, F.col("price"))
    return offers(s, d).withColumn("dear", dear).groupBy("entity").agg(F.expr("CASE WHEN count(dear) > 0 THEN sum(dear) div count(dear) END").alias("mean"))


QUERIES = {
    "fixed_price_text": lambda s, d: table(s, d, "part").select("p_partkey", S.fixed_price(price_text(F.col("p_partkey").cast("int"))).alias("fixed")),
    "completeness_score": completeness, "score_capped": capped, "seo_score": seo, "ux_score": ux, "data_quality": data_quality, "alias_confidence": alias_confidence,
    "merge_confidence": lambda s, d: D.cluster_confidence(named(s, d), ["cluster"], F.col("name"), "family"),
    "neighbours_first": shown_first, "name_assignment": by_name, "neutral_category": neutral, "area_compatible": areas, "similar_methods": similar_enough,
    "verified_unique": unique_vectors, "hybrid_match": hybrid, "subject_methods": methods, "entities_offering": offering, "method_prices": method_prices,
    "price_events_nearby": price_events, "entity_signals": signals, "canonical_documents": canonical, "reverse_patch": reverse, "promo_extraction": promos,
    "column_or_document": fallback, "json_totals": json_totals, "place_hierarchy": hierarchy, "package_labels": packages, "tagged_key_join": union_key, "bundle_or_computed": bundles,
    "bundles_due": due_bundles, "fixed_strictness": fixed_strictness, "category_context": context,
    "ended_backfill": ended, "report_refresh": refreshed, "verified_keys": verified_keys, "canonical_means": canonical_means, "mean_or_null": mean_or_null,
    "mention_count": lambda s, d: table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")),
    "ready_for_clustering": lambda s, d: vectors(s, d).groupBy("label", (F.col("entity") % 5).alias("part")).agg(F.count("vector").alias("n")).filter("n >= 8"),
    "shown_statuses": lambda s, d: table(s, d, "part").withColumn("status", F.get(F.array(*map(F.lit, ["verified", *S.HIDDEN_STATUSES, "extreme_outlier"])), (F.col("p_partkey") % 5).cast("int"))).filter(~F.col("status").isin(S.HIDDEN_STATUSES)).groupBy("status").agg(F.count("*").alias("n")),
}

_v = "vectors AS (SELECT vec_id AS id, embedding AS vector, label, vec_id % 50 AS entity FROM embeddings)"
_cos = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 4)"
_grams = "(SELECT list(DISTINCT g) FROM (SELECT substr(p, CAST(i AS INTEGER), 3) AS g FROM (SELECT '  ' || replace(lower({c}), ' ', '   ') || ' ' AS p), range(1, 100) t(i) WHERE i <= length(p) - 2) WHERE NOT ends_with(g, '  '))"
_method = "string_split(name, ' ')[-1]"
_lag = "lag({c}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_hit = "(NOT veto AND margin >= -1.5 + 1.6 * {s})"
ORACLES = {
    "fixed_price_text": f"SELECT p_partkey, {_fixed} AS fixed FROM part",
    "completeness_score": f"WITH {_stats} SELECT p_brand, {_complete} AS points FROM stats",
    "score_capped": f"""WITH {_stats}, r AS (SELECT p_brand, (total - described) / total AS poor, (total - fixed) / total AS loose, (total - timed) / total AS untimed FROM stats),
      i AS (SELECT p_brand, CAST(round(99 - 60 * untimed) AS INTEGER) AS score, (loose > 0.72)::INT + (loose > 0.71)::INT + (untimed > 0.2)::INT AS c, (loose > 0.7)::INT + (poor > 0)::INT AS m, (untimed > 0.1)::INT AS other FROM r)
      SELECT p_brand, least(score, 88, CASE WHEN c >= 3 THEN 60 WHEN c >= 1 THEN 75 WHEN m >= 1 THEN 85 WHEN c + m + other >= 1 THEN 95 ELSE 88 END) AS score FROM i""",
    "seo_score": """WITH k AS (SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS h, count(*) FILTER (c_mktsegment = 'MACHINERY') AS m, count(*) FILTER (c_mktsegment = 'FURNITURE') AS l FROM customer WHERE c_acctbal < 0 GROUP BY 1),
      p AS (SELECT c_nationkey, 10 - 2 * h - m - 0.5 * l AS p, h + m + l AS n FROM k) SELECT c_nationkey, CAST(greatest(0, least(10, round_even(CASE WHEN n > 0 AND p > 9 THEN 9 ELSE p END, 0))) AS INTEGER) AS points FROM p""",
    "ux_score": """WITH t AS (SELECT p_brand, p_type, count(*) AS n, count(*) - count(DISTINCT p_name) AS r FROM part GROUP BY 1, 2)
      SELECT p_brand, 5 - CAST(count(*) < 6 AS INTEGER) - CAST(count(*) FILTER (n > 20) > 0 AS INTEGER) - CAST(count(*) FILTER (n < 10) > 2 AS INTEGER) - CAST(sum(r) > 0 AS INTEGER) - CAST(max(n) > 10 * min(n) AS INTEGER) AS points FROM t GROUP BY 1""",
    "data_quality": "SELECT source, count(*) AS n, " + ", ".join(f"count(*) FILTER (regexp_matches(coalesce(text, ''), '{rx}')) AS {k}" for k, rx in S.TEXT_CHECKS.items()) + " FROM documents GROUP BY 1",
    "alias_confidence": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 1.0 WHEN p_partkey % 3 = 0 OR length(string_split(p_name, ' ')[-1]) >= 6 THEN 0.95 ELSE 0.85 END AS confidence FROM part""",
    "merge_confidence": f"""WITH a AS (SELECT cluster, family, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n FROM ({NAMES})),
      t AS (SELECT cluster, count(DISTINCT n) AS forms, bool_or(family IS NULL) OR max(length(n)) - min(length(n)) > 6 OR bool_or(family IS NOT NULL AND length(n) <= 5) AS low FROM a GROUP BY 1),
      f AS (SELECT x.cluster, max(levenshtein(x.n, y.n)) AS d FROM a x JOIN a y ON x.cluster = y.cluster AND x.n < y.n GROUP BY 1)
      SELECT cluster, CASE WHEN low THEN 'low' WHEN forms = 1 THEN 'high' WHEN d <= 2 THEN 'medium' ELSE 'low' END AS confidence FROM t LEFT JOIN f USING (cluster)""",
    "neighbours_first": f"""WITH {SCORED}, x AS (SELECT s.*, round(m, 3) AS m, CASE WHEN price_sim >= 0.97 THEN 'direct' WHEN size_sim >= 0.95 THEN 'cluster' ELSE 'new' END AS bucket FROM scored s JOIN near USING (subject, rival)),
      y AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY bucket = 'new', m, price_sim DESC, rival) AS k FROM x)
      SELECT subject, rival, bucket, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN bucket <> 'new' AND k <= 2 THEN k ELSE 3 END, price_sim DESC, rival) AS place FROM y""",
    "name_assignment": f"WITH {SAMPLES.rsplit('levels AS', 1)[0].rstrip().rstrip(',')} SELECT subject, o_id, s_name = o_name AS by_name, similarity FROM samples QUALIFY row_number() OVER (PARTITION BY subject ORDER BY s_name = o_name DESC, similarity DESC, o_id) = 1",
    "neutral_category": f"SELECT p_name, p_size, min({_kind}) AS kind FROM part GROUP BY 1, 2",
    "area_compatible": f"WITH {SAMPLES} SELECT s_name, o_name, count(*) AS n, bool_and(len(s_area) = 0 OR len(o_area) = 0 OR list_has_any(s_area, o_area)) AS compatible FROM samples GROUP BY 1, 2",
    "similar_methods": f"""WITH {_v}, refs AS (SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY entity ORDER BY id) <= 2), c AS (SELECT id, CASE WHEN id % 13 <> 0 THEN vector END AS vector, label, entity FROM vectors),
      b AS (SELECT c.id, c.entity, max(CAST(c.label = r.label AS INTEGER)) AS same, max({_cos.format(a='c.vector', b='r.vector')}) AS similarity FROM c JOIN refs r USING (entity) GROUP BY 1, 2)
      SELECT id, entity, same, similarity FROM c JOIN b USING (id, entity) WHERE vector IS NULL OR same = 1 OR similarity >= 0.05""",
    "verified_unique": f"""WITH {_v}, x AS (SELECT a.id, max({_cos.format(a='a.vector', b='b.vector')}) AS closest FROM vectors a JOIN vectors b ON a.label = b.label AND a.entity % 5 = b.entity % 5 AND a.entity <> b.entity WHERE a.id % 17 <> 0 GROUP BY 1)
      SELECT v.id, entity, closest FROM vectors v LEFT JOIN x USING (id) WHERE closest IS NULL OR closest < 0.3""",
    "hybrid_match": f"""WITH {_v}, n AS (SELECT p_name AS id, min(p_partkey) % 500 AS vid FROM part GROUP BY 1), c AS (SELECT p_type || ' ' || string_split(p_name, ' ')[-1] AS match, min(p_partkey) % 500 AS vid FROM part GROUP BY 1),
      a AS (SELECT n.id, vector, {_grams.format(c='n.id')} AS g FROM n JOIN vectors ON vid = vectors.id), b AS (SELECT match, vector, {_grams.format(c='match')} AS g FROM c JOIN vectors ON vid = vectors.id),
      p AS (SELECT a.id, match, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS t, a.vector AS x, b.vector AS y FROM a JOIN b ON list_has_any(a.g, b.g)),
      q AS (SELECT id, match, round(0.5 * i / (t - i) + 0.5 * list_cosine_similarity(x::DOUBLE[], y::DOUBLE[]), 4) AS score FROM p) SELECT * FROM q WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match) = 1""",
    "subject_methods": f"""WITH {OFFERS}, p AS (SELECT entity, {_method} AS method, name, count(*) AS n FROM offers GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY entity, method ORDER BY n DESC, name) AS k FROM p)
      SELECT entity, method, CAST(sum(n) AS BIGINT) AS n, count(*) AS names, string_agg(name, ',' ORDER BY name) FILTER (k <= 3) AS samples FROM k GROUP BY 1, 2""",
    "entities_offering": f"""WITH {OFFERS}, {RIVALS}, p AS (SELECT entity AS id, count(DISTINCT {_method}) AS methods, count(*) AS n FROM offers WHERE {_method} IN ('ring', 'bolt') GROUP BY 1)
      SELECT id, methods, n FROM p JOIN entity USING (id) ORDER BY methods DESC, n DESC, round({distance('52.1', '21.1', 'lat', 'lng')}, 3), id LIMIT 20""",
    "method_prices": f"""WITH {OFFERS}, {RIVALS} SELECT subject, {_method} AS method, count(*) AS n, count(DISTINCT rival) AS rivals, min(price) AS low, max(price) AS high, quantile_cont(price, 0.5) AS median
      FROM rivals JOIN offers ON entity = rival WHERE NOT package GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT rival) >= 2""",
    "price_events_nearby": f"""WITH {OFFERS}, {RIVALS}, x AS (SELECT entity, brand, category, sum(price) FILTER (year(ts) = 1995) // count(*) FILTER (year(ts) = 1995) AS a, sum(price) FILTER (year(ts) = 1996) // count(*) FILTER (year(ts) = 1996) AS b FROM offers GROUP BY 1, 2, 3),
      y AS (SELECT *, round(100.0 * (b - a) / a, 2) AS pct FROM x WHERE a IS NOT NULL AND b IS NOT NULL) SELECT subject, count(*) AS n, count(*) FILTER (pct > 0) AS raised, min(pct) AS lowest FROM rivals JOIN y ON entity = rival WHERE abs(pct) >= 10 GROUP BY 1""",
    "entity_signals": """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS c, CAST(sum(CAST(round(value, 2) AS DECIMAL(12,2))) AS DOUBLE) / count(value) AS m, max(CAST(event_type = 'purchase' AS INTEGER)) AS b FROM events GROUP BY 1, 2),
      x AS (SELECT user_id, c - lag(c) OVER w AS c, round(m - lag(m) OVER w, 3) AS m, b - lag(b) OVER w AS b FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day))
      SELECT user_id, count(*) FILTER (c > 1) AS spikes, count(*) FILTER (m < -0.1) AS drops, count(*) FILTER (b = 1) AS begun, count(*) FILTER (b = -1) AS ended FROM x GROUP BY 1""",
    "canonical_documents": """WITH k AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events), t AS (SELECT event_id, '{"k":' || k || ',"z":{"a":[{"v":null}],"b":' || k || '}}' AS doc FROM k) SELECT event_id, doc, sha256(doc) AS content_hash FROM t""",
    "reverse_patch": f"""WITH x AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, {', '.join(f'{_lag.format(c=c)} AS b{i}, {c} AS a{i}' for i, c in enumerate(VERSIONS))} FROM orders)
      SELECT o_orderkey, CAST(a0 IS DISTINCT FROM b0 AS BIGINT) + CAST(a1 IS DISTINCT FROM b1 AS BIGINT) AS n, concat_ws(';', CASE WHEN a0 IS DISTINCT FROM b0 THEN '{VERSIONS[0]}=' || b0 END, CASE WHEN a1 IS DISTINCT FROM b1 THEN '{VERSIONS[1]}=' || b1 END) AS patch FROM x WHERE k > 1""",
    "promo_extraction": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_partkey % 90 + 5 AS p FROM part)
      SELECT p_partkey, CASE WHEN k < 3 THEN p * 100 END AS promo_price, CAST(CASE k WHEN 0 THEN 10 WHEN 1 THEN 15 WHEN 2 THEN round_even((1 - p * 100 / 10000) * 100, 0) END AS BIGINT) AS discount_pct FROM p""",
    "column_or_document": "SELECT event_id, coalesce(CASE WHEN value > 10 THEN CAST(floor(value) AS BIGINT) END, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events",
    "json_totals": "WITH k AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS n, min(k) AS low, max(k) AS high, median(k) AS median FROM k GROUP BY 1",
    "place_hierarchy": """WITH RECURSIVE e AS (SELECT s_suppkey // 3 AS parent, s_suppkey AS child FROM supplier WHERE s_suppkey > 1), t AS (SELECT r AS id, r AS root, 0 AS depth FROM range(1, 10) x(r)
      UNION ALL SELECT child, root, depth + 1 FROM t JOIN e ON parent = id) SELECT id, root, min(depth) AS depth FROM t GROUP BY 1, 2""",
    "package_labels": """WITH l AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'p' WHEN p_partkey % 3 = 0 THEN '' ELSE 'n' END AS a, CASE WHEN p_partkey % 3 = 0 THEN 'p' WHEN p_partkey % 4 = 0 THEN '' ELSE 'n' END AS b FROM part)
      SELECT p_partkey, (a <> '' OR b <> '') AND a <> 'n' AND b <> 'n' AS package FROM l""",
    "tagged_key_join": """SELECT o_orderkey, CASE WHEN o_custkey % 3 < 2 THEN c_name ELSE (SELECT min(c_name) FROM customer x WHERE x.c_custkey % 25 = o_custkey % 25) END AS c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "bundle_or_computed": f"""WITH {OFFERS}, o AS (SELECT entity, CAST(sum(price) // count(*) AS BIGINT) AS v FROM offers GROUP BY 1) SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 100 ELSE v END AS value,
      CASE WHEN s_suppkey % 3 = 0 THEN 'cached' WHEN v IS NOT NULL THEN 'computed' END AS origin FROM supplier LEFT JOIN o ON entity = s_suppkey""",
    "bundles_due": "SELECT c_custkey, computed_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS computed_at FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey ORDER BY computed_at NULLS FIRST, c_custkey LIMIT 500",
    "fixed_strictness": f"""WITH {SAMPLES} SELECT subject, count(*) AS n, count(*) FILTER {_hit.format(s=0.5)} AS n_kept, {', '.join(f'count(*) FILTER ({c} = -1) AS {c}_against' for c in VOTES)},
      round(count(*) FILTER ({_hit.format(s=0.5)} AND {_hit.format(s=0.6)}) / nullif(count(*) FILTER {_hit.format(s=0.5)}, 0), 4) AS purity_kept, round(count(*) FILTER {_hit.format(s=0.6)} / count(*), 4) AS purity_in FROM margins GROUP BY 1""",
    "category_context": f"WITH {SAMPLES} SELECT subject, CASE WHEN count(*) FILTER (vote_category >= 0) > 0 THEN count(*) FILTER (vote_category >= 0) ELSE count(*) END AS n FROM voted GROUP BY 1",
    "ended_backfill": f"""WITH {OFFERS} SELECT entity, brand, category, max(ts) AS ended_at FROM offers o WHERE year(ts) = 1995 AND length(brand) <> 8 AND NOT EXISTS (SELECT 1 FROM offers n WHERE year(n.ts) = 1996 AND n.entity = o.entity AND n.brand = o.brand AND n.category = o.category) GROUP BY 1, 2, 3""",
    "report_refresh": """WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice AS p, lead(o_totalprice) OVER w AS b, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)),
      y AS (SELECT o_custkey, o_orderkey, round(100 * (p - b) / b, 1) AS pct FROM x WHERE k = 1 AND b > 0) SELECT * FROM y WHERE abs(pct) > 5""",
    "verified_keys": f"""WITH {OFFERS}, g AS (SELECT entity, count(DISTINCT brand || '/' || category) FILTER (promo) AS n FROM offers GROUP BY 1) SELECT entity, n, CASE WHEN n >= 60 THEN 'many' WHEN n >= 50 THEN 'some' WHEN n >= 3 THEN 'few' ELSE 'none' END AS grade FROM g""",
    "canonical_means": f"WITH {OFFERS} SELECT entity, category AS canon, CAST(sum(price) // count(*) AS BIGINT) AS mean FROM offers WHERE l_partkey % 4 <> 0 GROUP BY 1, 2",
    "mean_or_null": f"WITH {OFFERS} SELECT entity, CAST(sum(price) FILTER (price > 9500000) // count(*) FILTER (price > 9500000) AS BIGINT) AS mean FROM offers GROUP BY 1",
    "mention_count": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1",
    "ready_for_clustering": f"WITH {_v} SELECT label, entity % 5 AS part, count(*) AS n FROM vectors GROUP BY 1, 2 HAVING count(*) >= 8",
    "shown_statuses": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'verified' ELSE 'extreme_outlier' END AS status, count(*) AS n FROM part WHERE p_partkey % 5 IN (0, 4) GROUP BY 1",
}
