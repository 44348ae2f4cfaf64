"""Pairs of a radius, of an entity and of a price band against all pairs, with keys that hold most of the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketloom.operators import market, records
from marketloom.operators import relational as R


def metres(lat, lng):
    a, b = np.radians(lat), np.radians(lng)
    h = np.sin((a[None] - a[:, None]) / 2) ** 2 + np.cos(a[:, None]) * np.cos(a[None]) * np.sin((b[None] - b[:, None]) / 2) ** 2
    return 2 * 6371000.0 * np.arcsin(np.sqrt(h))


def test_radius_pairs_by_position(spark):
    rng = np.random.default_rng(5)
    lat = 52 + np.concatenate([np.full(300, 0.01), np.full(40, 0.03), rng.random(60) * 0.2])
    lng = 21 + np.concatenate([np.full(300, 0.01), np.full(40, 0.02), rng.random(60) * 0.2])
    ids = rng.permutation(len(lat))
    points = spark.createDataFrame(pd.DataFrame({"id": ids, "lat": lat, "lng": lng})).repartition(5)
    d = np.round(metres(lat, lng), 3)
    want = {(int(ids[i]), int(ids[j]), d[i, j]) for i, j in np.argwhere(d <= 5000.0) if ids[i] < ids[j]}
    odd = points.unionByName(spark.createDataFrame([(900, None, 21.0), (None, 52.01, 21.01)], "id long, lat double, lng double"))
    got = [tuple(r) for r in R.geo_pairs(odd, 5000.0).collect()]
    assert len(got) == len(want) and set(got) == want
    # Distances are found for 62 positions, not for 400 rows.
    assert R.position_pairs(points, points, 5000.0).count() <= 62 * 62


def test_fan_out_in_blocks(spark):
    items = spark.range(2500).select(F.col("id").alias("i"), F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 7 == 0, 2).otherwise(1)).alias("n"))
    watchers = spark.range(1200).select(F.when(F.col("id") != 5, F.col("id")).alias("w"), F.when(F.col("id") % 3 == 0, 2).otherwise(1).alias("n"))
    got = records.fan_out(items, watchers, "n", "i", "w")
    want = items.join(watchers, "n").select("i", "w")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    # The many rows of one entity are dealt to several tasks.
    sizes = [n for n in (len(p) for p in got.filter("i % 7 <> 0").rdd.glom().collect()) if n]
    assert max(sizes) < 0.7 * sum(sizes)


def test_neighbours_meet_only_rivals(spark, monkeypatch):
    from marketloom.plans import decisions

    monkeypatch.setattr(R, "geo_pairs", None)  # all pairs of the radius are not asked for
    assert decisions.shown_first(spark, "/root/testdata/sf0.001").count() > 0


def test_nearest_of_about_the_score_else_the_best(spark):
    rng = np.random.default_rng(6)
    lat = 52 + np.concatenate([np.full(60, 0.01), np.full(30, 0.0101), rng.random(40) * 0.3, [10.0, 10.0]])
    lng = 21 + np.concatenate([np.full(60, 0.01), np.full(30, 0.0102), rng.random(40) * 0.5, [10.0, 30.0]])
    score = np.round(rng.random(len(lat)) * 60, 1)  # many equal ones, and differences of the very width
    score[rng.random(len(lat)) < 0.1] = np.nan
    score[::9] += 500 * rng.random(len(score[::9]))
    d, width = metres(lat, lng), 5.0
    want = set()
    for i in range(len(lat)):
        at = [j for j in range(len(lat)) if j != i and d[i, j] <= 8000.0]
        near = [j for j in at if abs(score[i] - score[j]) <= width]
        low = lambda j: np.inf if np.isnan(score[j]) else -score[j]
        if at:
            want.add((i, min(near, key=lambda j: (round(d[i, j], 6), low(j), j)) if near else min(at, key=lambda j: (low(j), j))))
    rows = [(i, float(lat[i]), float(lng[i]), None if np.isnan(score[i]) else float(score[i])) for i in range(len(lat))]
    points = spark.createDataFrame([*rows, (900, None, 21.0, 1.0)], "id long, lat double, lng double, score double").repartition(4)
    got = [tuple(r) for r in market.nearest_or_best(points, 8000.0, width).collect()]
    assert len(got) == len(want) and set(got) == want


def test_last_near_is_the_test_of_doubles(spark):
    own = [-999.99, -1000.0, -1.1, 0.0, 24.01, 1023.7, 5432.1, 7192.3, 9999.99]
    last = [r[0] for r in spark.createDataFrame([(x,) for x in own], "own double").select(market.last_near(F.col("own"), 1000.0)).collect()]
    assert all(abs(o - x) <= 1000.0 < abs(o - np.nextafter(x, np.inf)) or x == o + 1000.0 + 2.0**-44 for o, x in zip(own, last, strict=True))


def test_bands_without_a_join(spark):
    rng = np.random.default_rng(7)
    price = np.concatenate([np.exp(rng.random(120) * 2) * 100, [1.0, 1.1, 1.21, 100.0, 100.0]]).round(2)
    rows = [("a" if i % 3 else None, i, float(x)) for i, x in enumerate(price)] + [("a", 900, None), ("a", 901, 0.0)]
    got = R.band_pairs(spark.createDataFrame(rows, "k string, id long, v double").repartition(4), ["k"], "id", "v", 1.1)
    want = [(i, j) for k, i, x in rows for l, j, y in rows if k == l == "a" and i < j and x and y and max(x, y) <= 1.1 * min(x, y)]
    assert sorted((r.a_id, r.b_id) for r in got.filter("k = 'a'").collect()) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().toString()
