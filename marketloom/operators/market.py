"""Operators on local markets: tiers of comparable prices, opening hours, teams, chains, matches and selections.

All are joins on keys, grouped aggregates and windows within a key; ties end with a unique column.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.operators.relational import latest_per_key, position_pairs, top_k
from marketloom.operators.staging import staged

DAY = 24 * 60


# --- prices by tier ---------------------------------------------------------------------------------------


def entity_floor(df: DataFrame, key: list[str], price: str = "price") -> DataFrame:
    """The lowest price of each entity and key: one value an entity, so that a large entity has one voice."""
    return df.groupBy("entity", *key).agg(F.min(price).alias(price))


def tiered(subjects: DataFrame, pool: DataFrame, tiers: list[tuple[str, list[str]]], least: int = 3) -> DataFrame:
    """``tier, n, median`` of the first tier with ``least`` entities; without one, ``subject_only`` and nulls.

    Each tier is one small aggregate of the pool that joins the subjects on its own key.
    """
    out = subjects
    for k, (_, key) in enumerate(tiers):
        level = entity_floor(pool, key).groupBy(*key).agg(F.count("*").alias(f"_n{k}"), F.percentile("price", F.lit(0.5)).alias(f"_m{k}"))
        out = out.join(level.filter(F.col(f"_n{k}") >= least), key, "left")
    first = lambda pick: F.coalesce(*[pick(k) for k in range(len(tiers))])
    tier = first(lambda k: F.when(F.col(f"_n{k}").isNotNull(), tiers[k][0]))
    return out.select(
        *subjects.columns, F.coalesce(tier, F.lit("subject_only")).alias("tier"),
        first(lambda k: F.col(f"_n{k}")).alias("n"), first(lambda k: F.col(f"_m{k}")).alias("median"),
    )


def best_row(df: DataFrame, key: list[str], priced: Column, size: Column, order: list[Column]) -> DataFrame:
    """One row of each key: with a market before without, then the larger sample, then the earlier row."""
    return top_k(df, key, [F.desc(priced), F.desc(size), *order], 1)


# --- opening hours ----------------------------------------------------------------------------------------


def open_minutes(span: Column) -> Column:
    """Length in minutes of ``{open, close}``; a close before the opening is after midnight."""
    return F.pmod(span["close"] - span["open"], F.lit(DAY))


def operations(hours: Column, evening: int = 20 * 60) -> list[Column]:
    """``weekly_hours, weekend, evening`` of an array of ``{day, open, close}``, day 0 being Monday; null: no hours."""
    week = F.coalesce(F.aggregate(hours, F.lit(0), lambda a, h: a + open_minutes(h)), F.lit(0)) / 60
    late = lambda h: (h["close"] > evening) | (h["close"] < h["open"])
    some = lambda test: F.coalesce(F.exists(hours, test), F.lit(False))
    return [F.round(week, 2).alias("weekly_hours"), some(lambda h: h["day"] >= 5).alias("weekend"), some(late).alias("evening")]


def hour_slots(df: DataFrame, key: str, hours: str, minutes: int = 120) -> DataFrame:
    """``key, day, slot`` for each slot of a day that the hours touch; what is after midnight belongs to the next day."""
    h = df.select(key, F.explode(hours).alias("h"))
    first = F.floor(F.col("h.open") / minutes)
    last = F.floor((F.col("h.open") + open_minutes(F.col("h")) - 1) / minutes)
    slot = h.filter(open_minutes(F.col("h")) > 0).select(key, F.col("h.day").alias("_d"), F.explode(F.sequence(first, last)).alias("_s"))
    day = F.pmod(F.col("_d") + F.floor(F.col("_s") * minutes / DAY), F.lit(7))
    return slot.select(key, day.cast("int").alias("day"), F.pmod("_s", F.lit(DAY // minutes)).cast("int").alias("slot")).distinct()


# --- teams and chains -------------------------------------------------------------------------------------


def team_changes(members: DataFrame, entity: str, member: str, period: str) -> DataFrame:
    """``n_added, n_left`` of each entity and period against its period before; the first period counts as added."""
    m = members.select(entity, member, period).distinct()
    last = m.groupBy(entity, period).agg(F.count("*").alias("_n"))
    last = last.withColumn("_before", F.lag(period).over(Window.partitionBy(entity).orderBy(period)))
    old = m.select(entity, member, F.col(period).alias("_before"))
    stay = m.join(last.select(entity, period, "_before"), [entity, period]).join(old, [entity, member, "_before"]).groupBy(entity, period).agg(F.count("*").alias("_stay"))
    size = last.select(entity, F.col(period).alias("_before"), F.col("_n").alias("_was"))
    out = last.join(stay, [entity, period], "left").join(size, [entity, "_before"], "left")
    kept = F.coalesce("_stay", F.lit(0))
    return out.select(entity, period, (F.col("_n") - kept).alias("n_added"), (F.coalesce("_was", F.lit(0)) - kept).alias("n_left"))


def migrations(members: DataFrame, entity: str, member: str, period: str) -> DataFrame:
    """Members that leave one entity and are new at another in the next period, one destination for each departure:
    ``member, period, origin, destination, confidence``.

    The k-th departure of a member and period goes to its k-th arrival, by entity; ``confidence`` is high where both are
    the only ones. Leavers and newcomers are numbered and joined by number, so a busy member costs its moves only.
    """
    m = members.select(entity, member, period).distinct()
    w = Window.partitionBy(entity, member).orderBy(period)
    seen = m.withColumns({"_next": F.lead(period).over(w), "_prev": F.lag(period).over(w)})
    left = seen.filter(~F.col("_next").eqNullSafe(F.col(period) + 1)).select(F.col(entity).alias("origin"), member, (F.col(period) + 1).alias(period))
    came = seen.filter(~F.col("_prev").eqNullSafe(F.col(period) - 1)).select(F.col(entity).alias("destination"), member, period)

    def numbered(df: DataFrame, side: str) -> DataFrame:
        own = Window.partitionBy(member, period)
        return df.withColumns({"_k": F.row_number().over(own.orderBy(side)), f"_n_{side}": F.count("*").over(own)})

    moves = numbered(left, "origin").join(numbered(came, "destination"), [member, period, "_k"]).filter("origin <> destination")
    sure = (F.col("_n_origin") == 1) & (F.col("_n_destination") == 1)
    return moves.select(member, period, "origin", "destination", F.when(sure, "high").otherwise("low").alias("confidence"))


def chain_trail(df: DataFrame, key: str, order: list[str], id_: str, every: int = 30) -> DataFrame:
    """``base, depth, is_checkpoint`` of each snapshot: a checkpoint stands alone, later ones build on the last one."""
    w = Window.partitionBy(key).orderBy(*order)
    depth = F.row_number().over(w) - 1
    numbered = df.withColumn("_i", depth).withColumn("_block", F.floor(F.col("_i") / every))
    base = F.first(id_).over(Window.partitionBy(key, "_block").orderBy(*order))
    return numbered.withColumns({"base": base, "depth": (F.col("_i") % every).cast("int"), "is_checkpoint": F.col("_i") % every == 0}).drop("_i", "_block")


# --- matches ----------------------------------------------------------------------------------------------


def package_matches(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each package with the single offer of its key that is closest in minutes, then in price: ``saving_pct, verdict``.

    Single offers are reduced to the first of each price and minutes; then to the nearest minutes below and above each
    package by one ordered window; only offers of these minutes meet the package.
    """
    at = [F.col(c) for c in order]
    single = latest_per_key(df.filter("NOT package"), [*key, "minutes", "price"], at)
    stops = single.select(*key, "minutes").distinct().withColumn("_stop", F.col("minutes"))
    wanted = df.filter("package").select(*key, "minutes").distinct().withColumn("_stop", F.lit(None).cast("int"))
    both = stops.unionByName(wanted)
    w = Window.partitionBy(*key).orderBy("minutes")
    below = F.last("_stop", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("_stop", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = both.withColumns({"_below": below, "_above": above}).filter("_stop IS NULL")
    gap = lambda c: F.abs(F.col(c) - F.col("minutes"))
    least = F.least(gap("_below"), gap("_above"))
    sides = F.array_distinct(F.array_compact(F.array(*[F.when(gap(c) == least, F.col(c)) for c in ("_below", "_above")])))
    near = near.select(*key, "minutes", F.explode(sides).alias("single_minutes"))
    prices = single.select(*key, *[F.col(c).alias(f"single_{c}") for c in (*order, "price", "minutes")])
    package = df.filter("package").select(*key, *order, "price", "minutes").join(near, [*key, "minutes"]).join(prices, [*key, "single_minutes"])
    best = top_k(package, [*key, *order], [F.abs(F.col("price") - F.col("single_price")), *[F.col(f"single_{c}") for c in order]], 1)
    saving = F.round(100.0 * (F.col("single_price") - F.col("price")) / F.col("single_price"), 2)
    return best.withColumn("saving_pct", saving).withColumn("verdict", X.package_verdict(F.col("saving_pct")))


def walk_up(gaps: DataFrame, own: DataFrame, key: list[str]) -> DataFrame:
    """Gaps whose wider key the subject does not serve already."""
    return gaps.join(own.select(*key).distinct(), key, "left_anti")


def first_keyword(text: Column, words: list[str]) -> Column:
    """The first of ``words``, by their order, that the text contains without case; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(w), w) for w in words])


def merged(df: DataFrame, key: str, name: str, weight: str) -> DataFrame:
    """One winner of each key by weight, then the shorter name, then the name; ``aliases`` are all names, sorted."""
    rank = F.struct(F.col(weight), -F.length(name), F.col(name))
    names = df.groupBy(key, name).agg(F.sum(weight).alias(weight))
    return names.groupBy(key).agg(F.max_by(name, rank).alias("winner"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("aliases"), F.sum(weight).alias("usage"))


# --- selections -------------------------------------------------------------------------------------------


def tiers_due(tiers: list[tuple[DataFrame, list[Column], int]], key: str) -> DataFrame:
    """``key, tier``: each tier's first rows up to its cap; a key in several tiers counts in the lowest one."""
    picked = None
    for k, (df, order, cap) in enumerate(tiers, 1):
        one = df.orderBy(*order).limit(cap).select(key, F.lit(k).alias("tier"))
        picked = one if picked is None else picked.unionByName(one)
    return picked.groupBy(key).agg(F.min("tier").alias("tier"))


def next_step(at: Column, passed: list[Column]) -> Column:
    """Number of the first step after ``at`` whose predicate holds; null when none is left."""
    return F.coalesce(*[F.when((F.lit(k) > at) & test, k) for k, test in enumerate(passed, 1)])


def last_near(own: Column, width: float) -> Column:
    """The greatest number whose difference from ``own`` is still ``width`` as doubles subtract: all numbers up to it, and no other, pass."""
    t = own + width
    step = F.abs(t) * (1.25 * 2.0**-53)
    tried = F.array(t - step, t, t + step, t + math.ulp(width) / 2)
    return F.array_max(F.filter(tried, lambda x: own - x >= -width))


def nearest_or_best(points: DataFrame, radius_m: float, width: float) -> DataFrame:
    """``a_id, b_id`` of rows ``(id, lat, lng, score)``: for each the nearest other within a radius whose score differs by at most ``width``, the
    best of these at equal distance, else the best score within the radius; ties by id.

    No row meets all rows of its radius: rings are tried from narrow to wide until one has an answer, and of a position's rows, sorted
    by score, only the best one that is not too high is looked at, in one window for each two positions. What no
    ring answers meets the two best rows of each position. The few rows without an answer of a dense place are far apart in
    score.
    """
    here, there = ["a_lat", "a_lng"], ["b_lat", "b_lng"]
    known = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.col("score").cast("double").alias("score"))
    known = known.filter("id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")
    ranked = Window.partitionBy(*there).orderBy(F.col("score").asc_nulls_first(), F.desc("id"))
    me = F.struct("score", "id")
    rows = known.withColumnsRenamed({"lat": "b_lat", "lng": "b_lng"}).withColumns({"me": me, "before": F.lag(me).over(ranked)})
    rows = staged(rows, "ranked")
    scored = rows.filter("score IS NOT NULL AND NOT isnan(score)")
    open_ = rows.withColumnsRenamed({"b_lat": "a_lat", "b_lng": "a_lng"}).select("id", *here, "score")
    place = lambda df, cols: df.select(F.col(cols[0]).alias("lat"), F.col(cols[1]).alias("lng"))
    found = []
    for ring in (radius_m / 256, radius_m / 64, radius_m / 16, radius_m / 4, radius_m):
        asked = open_.filter("score IS NOT NULL AND NOT isnan(score)")
        met = position_pairs(place(asked, here), place(scored, there), ring)
        asks = met.join(asked.withColumn("key", last_near(F.col("score"), width)), here).withColumn("kind", F.lit(1))
        has = met.join(scored, there).select(*met.columns, F.col("score").alias("key"), "id", "me", "before", F.lit(0).alias("kind"))
        run = Window.partitionBy(*here, *there).orderBy("key", "kind", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.when(F.col("kind") == 0, F.struct("me", "before")), ignorenulls=True).over(run)
        one = asks.unionByName(has, allowMissingColumns=True).withColumn("last", last).filter("kind = 1")
        best = F.when(F.col("last.me.id") == F.col("id"), F.col("last.before")).otherwise(F.col("last.me"))
        fits = one.withColumn("best", best).filter(F.abs(F.col("score") - F.col("best.score")) <= width)
        first = F.min(F.struct("distance_m", (-F.col("best.score")).alias("low"), F.col("best.id").alias("b_id")))
        found.append(staged(fits.groupBy(F.col("id").alias("a_id")).agg(first.alias("x")).select("a_id", "x.b_id"), "near"))
        open_ = staged(open_.join(found[-1].select(F.col("a_id").alias("id")), "id", "left_anti"), "open")
    top = top_k(rows, there, [F.desc("score"), F.col("id")], 2).select(*there, "me")
    met = position_pairs(place(open_, here), place(rows, there), radius_m).drop("distance_m")
    others = open_.select(F.col("id").alias("a_id"), *here).join(met, here).join(top, there).filter("a_id <> me.id")
    best = top_k(others.select("a_id", "me.*"), ["a_id"], [F.desc("score"), F.col("id")], 1).select("a_id", F.col("id").alias("b_id"))
    return reduce(DataFrame.unionByName, found, best)


def period_change(df: DataFrame, key: list[str], at: str, end: Column, days: int) -> DataFrame:
    """``recent, prior, change_pct`` counts of the last days before ``end`` and of as many before those."""
    middle, start = end - F.make_dt_interval(F.lit(days)), end - F.make_dt_interval(F.lit(2 * days))
    counts = df.filter((F.col(at) >= start) & (F.col(at) < end)).groupBy(*key).agg(
        F.count_if(F.col(at) >= middle).alias("recent"), F.count_if(F.col(at) < middle).alias("prior"))
    return counts.withColumn("change_pct", F.round(100.0 * F.try_divide(F.col("recent") - F.col("prior"), "prior"), 2))


# --- market of a phrase -----------------------------------------------------------------------------------


def phrase_pool(offers: DataFrame, anchor: Column) -> DataFrame:
    """Offers that the phrase hits (``anchor``) and those of the category that most of these have: one filter, as an offer
    that both ways find counts once, by the first. The category is one row."""
    hits = offers.filter(anchor).groupBy("category").agg(F.count("*").alias("n"))
    channel = hits.orderBy(F.desc("n"), "category").limit(1).select(F.col("category").alias("_channel"))
    marked = offers.join(F.broadcast(channel)).withColumn("anchor", anchor)
    return marked.filter(F.col("anchor") | (F.col("category") == F.col("_channel"))).drop("_channel")


def twin_services(services: DataFrame, pool: DataFrame, groups: DataFrame, reps: int, floor: float) -> DataFrame:
    """``key, category, group, by_name``: services (``key, category, vector``) of the groups' names, and others whose
    vector has a cosine of ``floor`` to one of a group's ``reps`` most offered services.

    An equal name beats any similarity; of several groups the most similar one wins, then the smallest name. Groups are a
    short ranked list, so their services travel as one row, and each service takes its best one without more rows.
    """
    offered = pool.groupBy("key", "category").agg(F.count("*").alias("n")).join(F.broadcast(groups.select("key")), "key").join(services, ["key", "category"])
    shown = top_k(offered, ["key"], [F.desc("n"), F.col("category")], reps)
    one = shown.agg(F.sort_array(F.collect_list(F.struct("key", "category", "vector"))).alias("_reps"))
    met = services.join(F.broadcast(one)).select(
        "key", "category",
        F.transform("_reps", lambda r: F.struct(
            (r["key"] != F.col("key")).cast("int").alias("other"), (-F.round(X.cosine(F.col("vector"), r["vector"]), 4)).alias("far"), r["key"].alias("group"),
        )).alias("_met"),
    )
    best = F.array_min(F.filter("_met", lambda m: (m["other"] == 0) | (m["far"] <= -floor)))
    return met.select("key", "category", best.alias("_b")).filter("_b IS NOT NULL").select("key", "category", F.col("_b.group").alias("group"), (F.col("_b.other") == 0).alias("by_name"))


def market_snapshot(offers: DataFrame, services: DataFrame, growth: DataFrame, anchor: Column, top: int = 12, reps: int = 3, floor: float = 0.6, thin: int = 2) -> DataFrame:
    """The market of a phrase: groups of its offers by name with what comparable services of the area cost.

    ``offers`` are ``key, category, brand, entity, price, minutes``. The ``top`` largest names of the pool form groups, each with
    a made-up subject (mode of brands, median minutes). Twins join them; an entity has one voice, its median price a minute in
    whole units, and a group's percentiles are on the subject's minutes. Groups of under ``thin`` entities are left out. ``demand`` is the
    median ``growth_pct`` (of ``growth``: ``entity, growth_pct``) of a group's entities; the greatest comes first.
    """
    pool = phrase_pool(offers, anchor)
    groups = pool.groupBy("key").agg(
        F.count("*").alias("n_pool"), F.count_if("anchor").alias("n_anchors"), F.mode("brand", True).alias("brand"), F.percentile("minutes", F.lit(0.5)).alias("minutes"),
    ).orderBy(F.desc("n_pool"), "key").limit(top)
    twins = twin_services(services, pool, groups, reps, floor)
    voices = offers.join(twins, ["key", "category"]).groupBy("group", "entity").agg(
        F.round(F.percentile(F.col("price") / F.col("minutes"), F.lit(0.5))).alias("unit"), F.count("*").alias("n"), F.count_if(~F.col("by_name")).alias("n_twins")
    )
    priced = voices.join(growth, "entity", "left").groupBy("group").agg(
        F.percentile("unit", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"), F.count("*").alias("entities"), F.sum("n").alias("n"),
        F.sum("n_twins").alias("n_twins"), F.round(F.median("growth_pct"), 2).alias("demand"),
    ).filter(F.col("entities") >= thin)
    cost = lambda i: F.round(F.col("p")[i] * F.col("minutes"), 2)
    out = groups.join(priced, groups["key"] == priced["group"]).select(
        "key", "brand", "minutes", "n_pool", "n_anchors", "n", "n_twins", "entities", X.sufficiency(F.col("entities")).alias("sufficiency"),
        cost(0).alias("p25"), cost(1).alias("median"), cost(2).alias("p75"), "demand",
    )
    return out.orderBy(F.desc_nulls_last("demand"), F.desc("entities"), "key")
