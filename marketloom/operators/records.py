"""Operators on price lists and reports: rewrites, change lists, scores, references and work selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import cleanup as C
from marketloom.functions import exprs as X
from marketloom.operators.relational import bounded, each_with_each, id_blocks


def last_writes(changes: DataFrame, order: Column) -> DataFrame:
    """``key, type, after``: the last non-empty text of each lookup key of ``before`` and type."""
    key = X.lookup_key(F.col("before"))
    used = changes.select(key.alias("key"), "type", "after", order.alias("_o")).filter("key <> '' AND after <> ''")
    return used.groupBy("key", "type").agg(F.max_by("after", "_o").alias("after"))


def rewrite(rows: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name`` replaced by the map's (``key, after``) and tidied, and ``was_renamed``.

    The map's keys are unique; adaptive execution sends a small map to every task and shuffles a large one.
    """
    key = X.lookup_key(F.col(name))
    to = names.select(F.col("key").alias("_key"), F.col("after").alias("_after"))
    joined = rows.withColumn("_key", key).join(to, "_key", "left")
    new = C.without_pictographs(C.sentence_case(C.tidy_name(F.coalesce("_after", name))))
    return joined.withColumn("_new", new).withColumn("was_renamed", ~F.col("_new").eqNullSafe(F.col(name))).withColumn(name, F.col("_new")).drop("_key", "_after", "_new")


def moved_repeats(rows: DataFrame, name: Column, category: str, order: list[str]) -> DataFrame:
    """``rows`` with ``repeated``: the name was last seen in another category. Names are compared without case."""
    before = F.lag(category).over(Window.partitionBy("_name").orderBy(*order))
    return rows.withColumn("_name", F.lower(F.trim(name))).withColumn("repeated", F.coalesce(before != F.col(category), F.lit(False))).drop("_name")


def change_list(old: DataFrame, new: DataFrame, position: list[str], fields: list[str]) -> DataFrame:
    """``position..., field, before, after`` of the fields that differ between rows in the same place."""
    a = old.select(*position, *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = new.select(*position, *[F.col(f).alias(f"_b_{f}") for f in fields])
    parts = [
        F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").cast("string").alias("before"), F.col(f"_b_{f}").cast("string").alias("after")))
        for f in fields
    ]
    return a.join(b, position).select(*position, F.inline(F.array_compact(F.array(*parts))))


def coverage_score(changed: Column, known: Column, priced: Column, timed: Column) -> Column:
    """0 to 100, an aggregate: 40 for the share of changed rows, 20 each for known, priced and timed ones."""
    share = lambda c: F.count_if(c) / F.count("*")
    return F.least(F.greatest(F.rint(40 * share(changed) + 20 * (share(known) + share(priced) + share(timed))), F.lit(0.0)), F.lit(100.0)).cast("int")


def weighted_checks(checks: dict[str, tuple[int, Column]], least: float = 0.7) -> list[Column]:
    """``score, acceptable, failed`` of named checks ``(weight, passed)``; a null check counts as failed."""
    passed = {k: F.coalesce(c, F.lit(False)) for k, (_, c) in checks.items()}
    total = sum(w for w, _ in checks.values())
    got = sum((F.when(passed[k], w).otherwise(0) for k, (w, _) in checks.items()), F.lit(0))
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in passed.items()]))
    score = got / F.lit(total) if total else F.lit(0.0)
    return [score.alias("score"), (score >= least).alias("acceptable"), failed.alias("failed")]


def existing_references(items: DataFrame, references: str, known: DataFrame, key: str) -> DataFrame:
    """Items with those of their references ``array<struct<type, id>>`` that ``known (type, id)`` has, in their order;
    items left with none go. ``key`` is unique."""
    each = items.select(key, F.posexplode(references).alias("_p", "_r")).withColumns({"type": F.col("_r.type"), "id": F.col("_r.id")})
    left = each.join(known.select("type", "id"), ["type", "id"], "left_semi")
    kept = left.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_r"))), lambda x: x["_r"]).alias(references))
    return items.drop(references).join(kept, key)


def verified_pairs(pairs: DataFrame, cache: DataFrame, verdicts: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``comparable, origin``: the cache's verdict, else the new one, else true.

    Both tables are ``key, comparable``; a pair's key is its two folded names, so spellings share a verdict.
    """
    key = F.concat_ws("|", X.fold_words(F.col(a)), X.fold_words(F.col(b)))
    old = cache.groupBy("key").agg(F.max("comparable").alias("_old"))
    new = verdicts.groupBy("key").agg(F.max("comparable").alias("_new"))
    out = pairs.withColumn("key", key).join(old, "key", "left").join(new, "key", "left")
    origin = F.when(F.col("_old").isNotNull(), "cache").when(F.col("_new").isNotNull(), "verdict").otherwise("default")
    return out.withColumns({"comparable": F.coalesce("_old", "_new", F.lit(True)), "origin": origin}).drop("key", "_old", "_new")


def retries(runs: DataFrame, key: list[str], now: Column, cooldown_min: int = 5, max_age_hours: int = 24, limit: int = 5) -> DataFrame:
    """The latest run of each key if it failed long enough ago, not too long, oldest first: a top-k.

    Reads ``started, finished, status``. A key whose latest run goes on is left out, as that run is not a failed one.
    """
    latest = runs.groupBy(*key).agg(F.max_by(F.struct("status", "finished"), "started").alias("_x"))
    due = latest.select(*key, F.col("_x.status").alias("status"), F.col("_x.finished").alias("finished")).filter(
        (F.col("status") == "failed")
        & (F.col("finished") <= now - F.expr(f"INTERVAL {cooldown_min} MINUTES"))
        & (F.col("finished") >= now - F.expr(f"INTERVAL {max_age_hours} HOURS"))
    )
    return due.orderBy("finished", *key).limit(limit)


def enrol(contacts: DataFrame, enrolled: DataFrame, key: str, state: Column, order: list[str], limit: int = 200) -> DataFrame:
    """Contacts in a state that are not enrolled yet, the first ``limit`` of them."""
    return contacts.filter(state).join(enrolled.select(key), key, "left_anti").orderBy(*order).limit(limit)


def fan_out(items: DataFrame, watchers: DataFrame, entity: str, item: str, watcher: str) -> DataFrame:
    """``item, watcher``: a row for each item and watcher of its entity, by an equi-join of blocks of ids on the entity."""
    blocks = id_blocks(items, [entity], item, "a").join(id_blocks(watchers, [entity], watcher, "b"), entity)
    return each_with_each(blocks, [entity]).toDF(item, watcher)


def keyword_coverage(keywords: DataFrame, texts: DataFrame) -> DataFrame:
    """``n, present, coverage`` in per cent: keywords that occur in some text, without case; 100 if there are none.

    Keywords are a short list, of checked size, that each task holds; the texts are read once and only the keywords
    that a partition has seen leave it. A blank keyword counts as asked and is never present.
    """
    asked = keywords.select(F.lower(F.trim(F.coalesce("keyword", F.lit("")))).alias("k"))
    said = texts.select(F.lower("text").alias("_t"))
    list_ = F.broadcast(bounded(asked.filter("k <> ''").distinct(), 10_000))
    seen = said.join(list_, F.col("_t").contains(F.col("k"))).select("k").distinct().withColumn("_in", F.lit(1))
    coverage = F.coalesce(F.round(F.try_divide(100.0 * F.count("_in"), F.count("*")), 2), F.lit(100.0))
    return asked.join(seen, "k", "left").agg(F.count("*").alias("n"), F.count("_in").alias("present"), coverage.alias("coverage"))
