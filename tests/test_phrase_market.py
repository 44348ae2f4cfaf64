"""The market of a phrase and the classifier cascade on small tables whose results are known."""

from pyspark.sql import functions as F

from marketloom.operators import decisions as D
from marketloom.operators import market as M


def test_market_of_a_phrase(spark):
    rows = [("nail gel", "nails", "A", e, 100 + e, 10) for e in range(1, 4)]  # anchors
    rows += [("polish", "nails", "B", 4, 300, 30), ("polish", "nails", "B", 5, 300, 30)]  # by the anchors' category
    rows += [("shellac", "other", "C", 6, 50, 10)]  # outside the pool; its vector is the anchors'
    rows += [("massage", "spa", "D", e, 900, 60) for e in range(1, 6)]  # neither
    offers = spark.createDataFrame(rows, "key string, category string, brand string, entity long, price long, minutes int")
    services = spark.createDataFrame(
        [("nail gel", "nails", [1.0, 0.0, 0.0]), ("polish", "nails", [0.9, 0.1, 0.0]), ("shellac", "other", [1.0, 0.05, 0.0]), ("massage", "spa", [0.0, 0.0, 1.0])],
        "key string, category string, vector array<double>",
    )
    growth = spark.createDataFrame([(1, 10.0), (2, 30.0), (6, 20.0), (4, None)], "entity long, growth_pct double")
    out = {r["key"]: r for r in M.market_snapshot(offers, services, growth, F.col("key").contains("gel"), thin=2).collect()}
    assert set(out) == {"nail gel", "polish"}
    gel, polish = out["nail gel"], out["polish"]
    assert (gel["n_pool"], gel["n_anchors"], gel["n"], gel["n_twins"], gel["entities"]) == (3, 3, 4, 1, 4)  # shellac is a twin
    assert gel["median"] == 100.0 and gel["demand"] == 20.0 and gel["sufficiency"] == "thin"
    # An equal name beats the higher similarity of the other group, so "polish" isn't a twin of "nail gel".
    assert (polish["n"], polish["n_twins"], polish["demand"], polish["sufficiency"]) == (2, 0, None, "insufficient")
    assert M.market_snapshot(offers, services, growth, F.col("key").contains("absent")).count() == 0
    assert set(r["key"] for r in M.market_snapshot(offers, services, growth, F.col("key").contains("gel"), thin=3).collect()) == {"nail gel"}


def test_cascade_takes_the_first_answer(spark):
    items = spark.createDataFrame([(k, k) for k in range(1, 7)], "id long, vid long")
    cached = spark.createDataFrame([(1, "from cache")], "id long, label string")
    alias = spark.createDataFrame([(1, "by alias"), (2, "by alias")], "id long, label string")
    near = spark.createDataFrame([(1, "x", 0.99), (3, "x", 0.75), (3, "y", 0.75), (4, "x", 0.6), (4, "y", 0.7), (5, "x", 0.5)], "vid long, label string, similarity double")
    out = {r["id"]: (r["label"], r["classifier"], r["candidates"]) for r in D.cascade(items, cached, alias, near, "id", "vid").collect()}
    assert out == {
        1: ("from cache", "cache", None), 2: ("by alias", "alias", None), 3: ("x", "vector", "x,y"),
        4: (None, "none", "y,x"), 5: (None, "none", None), 6: (None, "none", None),
    }
    assert D.cascade(items.limit(0), cached, alias, near, "id", "vid").count() == 0
