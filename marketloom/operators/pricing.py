"""Market price of a subject from its identity cluster, stage by stage.

A subject is one row with its pool, an array of the offers that it is compared with, so pairs are never dealt out, sorted or
written. Stages, in this order: votes on identity, adaptive strictness, coherence, one offer per entity, sufficiency, price. All are
expressions on the pool until the few offers that are left are priced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.functions.params import params_agree

#: Weights of the votes. The category weighs more where the subject's name is generic, less where it is specific.
WEIGHTS = {"params": 1.0, "package": 1.0, "area": 1.0, "duration": 0.5, "price": 1.5}
CATEGORY_WEIGHT = {"generic": 2.0, "specific": 0.4, "unknown": 0.6}
GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
REFERENCE_STRICTNESS = 0.6


def category_vote(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(X.overlap_min(a, b) >= 0.5, 1).otherwise(-1)


def vote_columns(get: Callable[[str], Column], agree: Callable[[Column, Column], Column] = params_agree) -> dict[str, Column]:
    """Votes ``vote_*`` of -1, 0 or 1. An abstaining vote is 0, never null.

    ``get`` gives ``s_*`` (subject) and ``o_*`` (offer) values: params (typed, see ``functions.params``, and compared by ``agree``), package, area (sorted
    array), words (of the category, none if it is neutral), minutes, price. Prices are compared per minute where both
    have price and minutes, else as they are; a price or minutes of 0 are unknown.
    """
    known = lambda c: F.coalesce(get(f"s_{c}") > 0, F.lit(False)) & F.coalesce(get(f"o_{c}") > 0, F.lit(False))
    times = lambda x, y, n: F.greatest(x, y) >= n * F.least(x, y)
    s_price, o_price = (F.when(known("minutes"), get(f"{p}_price") / get(f"{p}_minutes")).otherwise(get(f"{p}_price")) for p in "so")
    s_area, o_area = get("s_area"), get("o_area")
    return {
        "vote_params": agree(get("s_params"), get("o_params")),
        "vote_package": F.when(get("s_package") != get("o_package"), -1).otherwise(0),
        "vote_area": F.when((F.size(s_area) > 0) & (F.size(o_area) > 0) & (s_area != o_area), -1).otherwise(0),
        "vote_category": category_vote(get("s_words"), get("o_words")),
        "vote_duration": F.when(known("minutes") & times(get("s_minutes"), get("o_minutes"), 3), -1).otherwise(0),
        "vote_price": F.when(known("price") & times(s_price, o_price, 4), -1).otherwise(0),
    }


def votes(df: DataFrame, agree: Callable[[Column, Column], Column] = params_agree) -> DataFrame:
    """Votes of rows that hold one pair each, see ``vote_columns``."""
    return df.withColumns(vote_columns(F.col, agree))


def near(df: DataFrame, floor: float = 0.0) -> DataFrame:
    """Rows ``s_minutes, o_minutes`` of one pair each from a ``similarity`` of ``floor`` up."""
    ratio = X.ratio_similarity(F.col("s_minutes"), F.col("o_minutes"))
    rows = df.withColumn("similarity", F.round(ratio, 4))
    return rows.filter(F.col("similarity") >= floor) if floor > 0 else rows.filter(ratio.isNotNull())  # none is below 0


def margin(generic: Column, get: Callable[[str], Column] = F.col) -> Column:
    """Votes by weight; ``generic`` may be null where the subject's name gives no answer."""
    category = F.when(generic, CATEGORY_WEIGHT["generic"]).when(~generic, CATEGORY_WEIGHT["specific"]).otherwise(CATEGORY_WEIGHT["unknown"])
    return sum((get(f"vote_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0)) + get("vote_category") * category


def level_margin(strictness: float | Column) -> float | Column:
    """The least margin of a match."""
    return -1.5 + 1.6 * strictness


def matches(strictness: Column, get: Callable[[str], Column] = F.col) -> Column:
    """No veto, and a margin of at least ``-1.5 + 1.6 * strictness``."""
    veto = (get("vote_params") == -1) | (get("vote_package") == -1) | (get("vote_area") == -1)
    return ~veto & (get("margin") >= level_margin(strictness))


VOTES = ["vote_params", "vote_package", "vote_area", "vote_category", "vote_duration", "vote_price"]
#: A voted pair: minutes and id come first, as pools are sorted by them. What only votes read is gone.
PAIR = ["o_minutes", "o_id", "o_entity", "o_price", "o_package", "o_name", "other", "similarity", *VOTES, "margin", "peer_max_sim"]


def voted(df: DataFrame, generic: Column, floor: float = 0.0) -> DataFrame:
    """Rows ``s_*, o_*`` of one pair each from a similarity of ``floor`` up, with votes and margin and without what only these read."""
    marked = votes(near(df, floor)).withColumn("margin", margin(generic)).withColumn("other", F.col("o_folded") != F.col("s_folded"))
    return marked.drop(*[f"{p}_{c}" for p in "so" for c in ("params", "area", "words", "folded")])


def pooled(voted_rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``pool`` of each key: its voted pairs by minutes and id, each with the best similarity to another one: to a neighbour by minutes."""

    def beside(all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            peers = [X.ratio_similarity(x["o_minutes"], F.get(all_, at)["o_minutes"]) for at in (i - 1, i + 1)]
            known = [F.when(F.get(all_, at).isNotNull(), p) for at, p in zip((i - 1, i + 1), peers, strict=True)]
            return F.struct(*[x[f].alias(f) for f in PAIR[:-1]], F.round(F.greatest(*known), 4).alias("peer_max_sim"))

        return F.transform(all_, one)

    pools = voted_rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*PAIR[:-1]))).alias("pool"))
    return pools.withColumn("pool", beside(F.col("pool")))


def entity_of(x: Column) -> Column:
    """What stands for an entity: an offer without one stands for itself."""
    return F.coalesce(F.concat(F.lit("e"), x["o_entity"].cast("string")), F.concat(F.lit("o"), x["o_id"]))


def adaptive_strictness(df: DataFrame, prefer: str = "sufficiency", min_entities: int = 3, min_purity: float = 0.9) -> DataFrame:
    """``strictness, purity, entities`` of each row's ``pool``: the smallest strictness of the grid whose matches are pure and many
    enough, else the best by the preference.

    A pair that matches at one strictness matches at all smaller ones, so each is reduced to the number of levels that it reaches.
    """
    reached = lambda x: sum((matches(F.lit(s), lambda c: x[c]).cast("int") for s in GRID), F.lit(0))
    pure = lambda x: matches(F.lit(REFERENCE_STRICTNESS), lambda c: x[c])
    marks = F.transform("pool", lambda x: F.struct(reached(x).alias("n"), pure(x).alias("pure"), entity_of(x).alias("entity")))

    def level(k: int, strictness: float) -> Column:
        hits = F.filter("_marks", lambda x: x["n"] > k)
        purity = F.coalesce(F.try_divide(F.size(F.filter(hits, lambda x: x["pure"])), F.size(hits)), F.lit(1.0))
        entities = F.size(F.array_distinct(F.transform(hits, lambda x: x["entity"]))).cast("long")
        return F.struct(F.lit(strictness).alias("strictness"), purity.alias("purity"), entities.alias("entities"), F.lit(-k).alias("o"))

    levels = F.array(*[level(k, s) for k, s in enumerate(GRID)])
    first = F.try_element_at(F.filter("_levels", lambda x: (x["purity"] >= min_purity) & (x["entities"] >= min_entities)), F.lit(1))
    by = ("entities", "purity") if prefer == "sufficiency" else ("purity", "entities")
    best = F.array_max(F.transform("_levels", lambda x: F.struct(x[by[0]].alias("a"), x[by[1]].alias("b"), x["o"].alias("o"), x.alias("x"))))["x"]
    picked = df.withColumn("_marks", marks).withColumn("_levels", levels).withColumn("_pick", F.coalesce(first, best))
    return picked.withColumns({c: F.col(f"_pick.{c}") for c in ("strictness", "purity", "entities")}).drop("_marks", "_levels", "_pick")


def reached(get: Callable[[str], Column] = F.col) -> Column:
    """How many levels of the grid a pair matches at: one that matches at a strictness matches at all smaller ones."""
    return sum((matches(F.lit(s), get).cast("int") for s in GRID), F.lit(0))


def _hits() -> dict[str, Column]:
    """Of each level: pairs that match at it, and how many of these are pure."""
    hit = lambda k: F.col("reached") > k
    return {f"_n{k}": hit(k) for k in range(len(GRID))} | {f"_pure{k}": hit(k) & F.col("pure") for k in range(len(GRID))}


def _picked(prefer: str = "sufficiency", min_entities: int = 3, min_purity: float = 0.9) -> Column:
    """``purity, entities, strictness, level`` that ``adaptive_strictness`` picks, from counts ``_n, _pure, _entities`` of each level."""

    def level(k: int) -> Column:
        purity, entities = F.coalesce(F.try_divide(F.col(f"_pure{k}"), F.col(f"_n{k}")), F.lit(1.0)), F.col(f"_entities{k}")
        by = (entities, purity) if prefer == "sufficiency" else (purity, entities)
        return F.struct(by[0].alias("a"), by[1].alias("b"), F.lit(-k).alias("o"), purity.alias("purity"), entities.alias("entities"), F.lit(GRID[k]).alias("strictness"), F.lit(k).alias("level"))

    levels = [level(k) for k in range(len(GRID))]
    good = [F.when((x["purity"] >= min_purity) & (x["entities"] >= min_entities), x) for x in levels]
    return F.coalesce(*good, F.greatest(*levels))


def strictness_of(voted_rows: DataFrame, key: Sequence[str], **how) -> DataFrame:
    """``strictness, purity, entities`` of each key as ``adaptive_strictness`` picks them, from voted pairs that are counted as they come
    by entity and then by key. All pairs have an ``o_entity``."""
    marks = voted_rows.withColumns({"reached": reached(), "pure": matches(F.lit(REFERENCE_STRICTNESS))})
    by_entity = marks.groupBy(*key, "o_entity").agg(F.max("reached").alias("_best"), *[F.count_if(v).alias(k) for k, v in _hits().items()])
    counts = by_entity.groupBy(*key).agg(*[F.sum(k).alias(k) for k in _hits()], *[F.count_if(F.col("_best") > k).alias(f"_entities{k}") for k in range(len(GRID))])
    return counts.withColumn("_pick", _picked(**how)).select(*key, *[F.col(f"_pick.{c}").alias(c) for c in ("strictness", "purity", "entities")])


def minutes_from(minutes: Column, own: Column, floor: float = 0.0) -> Column:
    """Minutes, an array, from a similarity of ``floor`` to the subject's up, sorted."""
    return F.array_sort(F.filter(minutes, lambda m: F.round(X.ratio_similarity(own, m), 4) >= floor) if floor > 0 else minutes)


def with_peer(pairs: DataFrame) -> DataFrame:
    """``peer_max_sim`` instead of ``pool``, the sorted minutes of all offers of the key: the best similarity of an offer to another one is that
    to a neighbour by minutes, and 1 where two have the same. Offers without minutes have no neighbours and are nobody's.

    It comes before the votes: its lambdas keep these out of the join's generated method, which would have over 8000 bytes, and Java
    never compiles such a one (eight times slower).
    """
    at = F.array(F.array_position("pool", F.col("o_minutes")).cast("int"))
    beside = F.array_compact(F.flatten(F.transform(at, lambda i: F.array(F.get("pool", i - 2), F.get("pool", i)))))
    peer = F.round(F.array_max(F.transform(beside, lambda m: X.ratio_similarity(F.col("o_minutes"), m))), 4)
    return pairs.withColumn("peer_max_sim", peer).drop("pool")


def candidates(pairs: DataFrame, key: Sequence[str], gap: float = 0.08, sure: float = 0.90) -> DataFrame:
    """Voted pairs that match at the lowest level of the grid, with ``other`` (another name), ``suspect`` and without what votes read.
    The number of a row keeps the filter above the votes; in the join's condition they would be worked out once more."""
    hits = pairs.withColumn("_row", F.monotonically_increasing_id()).filter((F.col("_row") >= 0) & matches(F.lit(GRID[0])))
    suspect = F.coalesce((F.col("peer_max_sim") - F.col("similarity") > gap) & (F.col("similarity") < sure), F.lit(False))
    return hits.select(
        *key, "o_entity", "similarity", "o_id", "o_price", "o_minutes", "o_package", "s_price", "s_minutes", "margin",
        (F.col("o_folded") != F.col("s_folded")).alias("other"), suspect.alias("suspect"),
    )


def kept(hits: DataFrame, key: Sequence[str], until: str = "single", least: int = 2) -> DataFrame:
    """Rows of ``candidates`` that strictness and coherence keep (see ``adaptive_strictness`` and ``coherent``), one an entity unless
    ``until`` is ``coherent``. All windows share one sort by key, entity, similarity and id."""
    of_key, of_entity = Window.partitionBy(*key), Window.partitionBy(*key, "o_entity")
    order = of_entity.orderBy(F.desc("similarity"), "o_id")
    over = lambda s: F.col("margin") >= level_margin(s)  # noqa: E731  # vetoes are gone
    marked = hits.withColumn("_first", F.row_number().over(order) == 1).withColumns({"reached": sum((over(s).cast("int") for s in GRID), F.lit(0)), "pure": over(REFERENCE_STRICTNESS)})
    marked = marked.withColumn("_best", F.max("reached").over(of_entity))
    seen = {f"_entities{k}": F.col("_first") & (F.col("_best") > k) for k in range(len(GRID))}
    counts = {c: F.count_if(v).over(of_key) for c, v in (_hits() | seen).items()}
    rows = marked.withColumns(counts).withColumn("_level", _picked()["level"]).filter("reached > _level").select(*hits.columns)
    rows = rows.withColumn("_suspects", F.count_if("suspect").over(of_key)).filter(~((F.col("_suspects") >= least) & F.col("suspect") & F.col("other")))
    if until == "single":
        rows = rows.withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    return rows.select(*hits.columns)


def coherent(pool: Column, gap: float = 0.08, sure: float = 0.90, least: int = 2) -> Column:
    """The pool without foreign blocks: an offer that is closer to its peers than to the subject, and not sure itself,
    is suspect; of two or more suspects of a subject, those with another name than the subject's go."""
    suspect = lambda x: F.coalesce((x["peer_max_sim"] - x["similarity"] > gap) & (x["similarity"] < sure), F.lit(False))
    many = lambda all_: F.size(F.filter(all_, suspect)) >= least
    return F.element_at(F.transform(F.array(pool), lambda all_: F.when(many(all_), F.filter(all_, lambda x: ~(suspect(x) & x["other"]))).otherwise(all_)), 1)


def one_per_entity(pool: Column) -> Column:
    """The most similar offer of each entity; ties by offer id."""
    ordered = F.array_sort(F.transform(pool, lambda x: F.struct(entity_of(x).alias("e"), (-x["similarity"]).alias("far"), x["o_id"].alias("id"), x.alias("x"))))
    first = lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["e"] != x["e"]))
    return F.transform(F.element_at(F.transform(F.array(ordered), first), 1), lambda x: x["x"])


def exploded(df: DataFrame, *columns: str | Column) -> DataFrame:
    """A row a pair of ``pool``, with ``columns``. The explosion is an outer one, as for an inner one the optimizer adds a filter on
    the array's size below it, and with it the whole expression of the pool once more for each step that reads it."""
    return df.select(*columns, F.inline_outer("pool")).filter("o_id IS NOT NULL")


def kept_pool(df: DataFrame, until: str = "single") -> DataFrame:
    """Rows whose ``pool`` is what strictness and coherence keep, one offer an entity unless ``until`` is ``coherent``."""
    level = adaptive_strictness(df).drop("purity", "entities")
    kept = level.withColumn("pool", coherent(F.filter("pool", lambda x: matches(F.col("strictness"), lambda c: x[c])))).drop("strictness")
    return kept.withColumn("pool", one_per_entity(F.col("pool"))) if until == "single" else kept


def price(df: DataFrame, key: Sequence[str] = ("subject",)) -> DataFrame:
    """Price of each subject from its final offers, one an entity; packages count as entities but not in prices.

    Where the subject's minutes are known, offers with minutes decide: the price is their median rate times the
    subject's minutes, percentiles are those of their rounded prices for these minutes, and offers without minutes are left
    out. Where none has minutes, or the subject's are unknown, raw prices decide. Too few entities give no price.
    """
    single = ~F.col("o_package")
    timed = single & (F.col("o_minutes") > 0)
    rate = F.when(timed, F.col("o_price") / F.col("o_minutes"))
    raw = F.when(single, F.coalesce("o_price", F.lit(0)).cast("double"))
    whole = lambda x: F.bround(F.round(x, 6)).cast("long")
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    found = df.groupBy(*key).agg(
        F.count_if(single).alias("n_offers"), F.count("*").alias("n_entities"), F.max("s_price").alias("subject_price"), F.max("s_minutes").alias("subject_minutes"),
        F.percentile(rate, F.lit(0.5)).alias("_rate"), F.percentile(F.when(F.col("s_minutes") > 0, whole(rate * F.col("s_minutes"))), quarters).alias("_timed"),
        F.percentile(raw, quarters).alias("_raw"),
    )
    by_rate = F.col("_timed").isNotNull()
    status = X.sufficiency(F.col("n_entities"))
    enough = status != "insufficient"
    rated = found.withColumn("_p", F.when(by_rate, F.col("_timed")).otherwise(F.col("_raw"))).withColumn("status", status)
    market = F.when(by_rate, whole(F.col("_rate") * F.col("subject_minutes"))).otherwise(whole(F.col("_raw")[1]))
    priced = rated.select(
        *key, "subject_price", "subject_minutes", "n_offers", "n_entities", "status", F.when(enough, market).alias("market_price"),
        *[whole(F.col("_p")[k]).alias(f"market_p{q}") for k, q in enumerate((25, 50, 75))], F.when(by_rate, F.round("_rate", 4)).alias("rate_median"),
    )
    deviation = F.round(100.0 * (F.col("subject_price") - F.col("market_price")) / F.nullif("market_price", F.lit(0)), 2)
    return priced.withColumn("deviation_pct", deviation).withColumn("action", X.action_c(F.col("deviation_pct")))


def result_rows(priced: DataFrame, key: Sequence[str] = ("subject",)) -> DataFrame:
    """The report's row of each priced subject. Where entities are too few the subject stands alone: no market, no place in it."""
    alone = F.col("status") == "insufficient"
    only = lambda x: F.when(~alone, x)
    place = X.rank_linear_map(F.col("subject_price"), F.col("market_p25"), F.col("market_p75"))
    own_rate = F.when(F.col("subject_minutes") > 0, F.col("subject_price") / F.col("subject_minutes"))
    return priced.select(
        *key,
        F.when(alone, "subject_only").otherwise("verified").alias("verification"),
        F.when(alone, "subject_only").otherwise(F.col("action")).alias("action"),
        only(F.col("market_p25")).alias("market_low"), "market_price", only(F.col("market_p75")).alias("market_high"),
        F.round(F.when((F.col("market_price") != 0) & (F.col("subject_price") != 0), place), 2).alias("percentile"),
        "deviation_pct", F.bround(own_rate).cast("long").alias("own_rate"), F.bround("rate_median").cast("long").alias("market_rate"),
        only(F.round(100.0 * (own_rate - F.col("rate_median")) / F.nullif("rate_median", F.lit(0.0)), 2)).alias("rate_deviation_pct"),
        F.col("n_entities").alias("sample_size"),
    )


def rerun_if_few(strict: DataFrame, wide: DataFrame, services: DataFrame, share: float = 0.2) -> DataFrame:
    """Result rows of each report from its strict run, or from the wide one where under ``share`` of its services are verified and
    the wide run verifies more; ``widened`` tells which. ``services`` has all ``(report, subject)``, also those that no run priced,
    which stand alone. The choice is made once a report, from two counts."""
    check = lambda df, p: df.select("subject", (F.col("verification") == "verified").alias(p))
    both = services.join(check(strict, "s"), "subject", "left").join(check(wide, "w"), "subject", "left")
    counts = both.groupBy("report").agg(F.count("*").alias("n"), F.count_if("s").alias("n_s"), F.count_if("w").alias("n_w"))
    choice = counts.select("report", ((F.col("n_s") / F.col("n") < share) & (F.col("n_w") > F.col("n_s"))).alias("widened"))
    rows = services.join(choice, "report")
    of = lambda df, wide: rows.filter(F.col("widened") == F.lit(wide)).join(df, "subject", "left")
    return of(strict, False).unionByName(of(wide, True)).fillna("subject_only", ["verification", "action"])


def market_price(df: DataFrame, key: Sequence[str] = ("subject",)) -> DataFrame:
    """The whole chain for every row's subject (``s_price, s_minutes, pool``): one pass, as only the offers that are kept become rows."""
    kept = exploded(kept_pool(df), *key, "s_price", "s_minutes")
    return price(kept, key)
