"""Nearest places against all pairs, in a city, in the country and where many share a position."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketloom.operators.places import nearest_places


def test_equals_all_pairs_and_meets_few(spark):
    rng = np.random.default_rng(3)
    parts = [(rng.normal(0, 0.0005, 900), rng.normal(0, 0.0005, 900)), (rng.random(150) * 0.6, rng.random(150) * 0.6), (np.full(200, 0.003), np.full(200, 0.003))]
    lat, lng = 52 + np.concatenate([a for a, _ in parts]), 21 + np.concatenate([b for _, b in parts])
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(lat)), "lat": lat, "lng": lng, "place": 1})).repartition(8)
    a, b = np.radians(lat), np.radians(lng)
    h = np.sin((a[None] - a[:, None]) / 2) ** 2 + np.cos(a[:, None]) * np.cos(a[None]) * np.sin((b[None] - b[:, None]) / 2) ** 2
    d = np.round(2 * 6371000.0 * np.arcsin(np.sqrt(h)), 3)
    np.fill_diagonal(d, np.inf)
    for k, radius in ((8, 5000.0), (3, 700.0)):
        want = {(i, int(j), n + 1) for i in range(len(d)) for n, j in enumerate(np.lexsort((np.arange(len(d)), d[i]))[:k]) if d[i, j] <= radius}
        got = {(r.a_id, r.b_id, r.place) for r in nearest_places(points, points, k, radius).collect()}
        assert got == want
    met = nearest_places(points, points, 8, 5000.0, met=True).groupBy("a_lat", "a_lng").agg(F.sum("n").alias("n"))
    assert met.agg(F.max("n")).first()[0] <= 50 * 8


def test_other_subjects_nulls_and_empty(spark):
    schema = "id long, lat double, lng double"
    points = spark.createDataFrame([(1, 52.0, 21.0), (2, 52.0, 21.0), (3, 52.01, 21.0), (4, None, 21.0), (5, -10.0, -60.0)], schema)
    subjects = spark.createDataFrame([(1, 52.0, 21.0), (9, 52.011, 21.0), (7, 0.0, 0.0), (8, None, None)], schema)
    got = sorted((r.a_id, r.b_id) for r in nearest_places(subjects, points, 2, 5000.0).collect())
    assert got == [(1, 2), (1, 3), (9, 1), (9, 3)]
    assert nearest_places(subjects, points.limit(0), 2, 5000.0).count() == 0
    assert nearest_places(subjects.limit(0), points, 2, 5000.0).count() == 0
