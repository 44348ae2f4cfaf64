"""Pairs of services and rivals' offers: what is moved, what is sorted, and the operators that reduce pairs as they come."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.params import by_kind, kinds_agree, typed_params
from marketloom.operators import decisions as D
from marketloom.plans import decisions as plans
from marketloom.plans import pricing
from tests.oracle import differences
from tests.test_rules import AGREE

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A market of 200 entities at one position, six offers each of one service."""
    d = str(tmp_path_factory.mktemp("crowd"))
    ids = np.arange(200) * 1000
    pd.DataFrame({"s_suppkey": ids, "s_nationkey": 1, "s_acctbal": 1.0}).to_parquet(f"{d}/supplier.parquet")
    names = ["small red bolt", "blue bolt", "hot gear", "large ring"]
    pd.DataFrame({"p_partkey": np.arange(48), "p_name": [names[i % 4] for i in range(48)], "p_brand": "Brand#1", "p_type": "SMALL"}).to_parquet(f"{d}/part.parquet")
    n = len(ids) * 6
    i = np.arange(n)
    line = {"l_orderkey": i, "l_partkey": i * 7 % 48, "l_suppkey": np.repeat(ids, 6), "l_linenumber": (i % 6 + 1 + (i % 13 == 0)).astype("int32"), "l_quantity": 1.0 + i * 11 % 50}
    day = pd.Timestamp("2024-01-01") + pd.to_timedelta(i % 3, unit="D")  # many equal days: ties by id
    pd.DataFrame(line | {"l_extendedprice": 10.0 + i * 37 % 90, "l_discount": 0.0, "l_tax": 0.0, "l_shipdate": day.astype("datetime64[us]")}).to_parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["fixed_strictness", "name_assignment", "category_context", "method_prices"])
def test_crowd_equals_sql(spark, crowd, name):
    assert differences(spark, plans.QUERIES[name], plans.ORACLES[name], crowd) == ""


def test_margins_of_a_crowd(spark, crowd):
    assert differences(spark, pricing.QUERIES["identity_margin"], pricing.ORACLES["identity_margin"], crowd) == ""


def test_only_offers_of_rivals_are_dealt_to_blocks(spark, crowd):
    a, b = pricing.sides(spark, crowd, ["minutes"])
    assert a.count() == 200
    # Nine of 200 entities are rivals of others: their offers go to the seven blocks, no one else's do.
    assert b.select("o_entity").distinct().count() == 9
    assert b.count() <= 9 * 6 * a.select("block").distinct().count()


def above_join(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Join Inner")], plan


@pytest.mark.parametrize("query", [plans.fixed_strictness, pricing.QUERIES["identity_margin"], plans.context])
def test_pairs_are_reduced_as_they_come(spark, query):
    top, plan = above_join(query(spark, SMALL))
    assert "Aggregate" in top and "Window" not in top and "lambda" not in plan and "Generate inline" not in plan


def test_matches_are_not_sorted(spark):
    _, plan = above_join(plans.by_name(spark, SMALL))
    best = plan.index("Aggregate")
    assert "Window" not in plan[:best] and "Window" not in plan[best : plan.index("Join Inner", best)]


def test_kinds_agree_as_maps_do(spark):
    df = spark.createDataFrame(AGREE, "a string, b string, want int").withColumns({c: by_kind(typed_params(F.col(c))) for c in "ab"})
    assert [r.got == r.want for r in df.select("want", kinds_agree(F.col("a"), F.col("b")).alias("got")).collect()] == [True] * len(AGREE)


def test_best_ranked_is_assigned(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), None if n == 2 else bool(n), float(s) / 32, int(i)) for i, (k, n, s) in enumerate(zip(rng.integers(0, 60, 400), rng.integers(0, 3, 400), rng.integers(0, 33, 400), strict=True))]
    df = spark.createDataFrame(rows, "k int, same boolean, s double, rank long").withColumn("s", F.round("s", 4))
    want = D.assigned(df, ["k"], F.col("same"), "s", "rank").select("k", "by_name", "s", "rank").collect()
    got = D.best_ranked(df, ["k"], F.col("same"), F.col("s"), F.col("rank")).select("k", "by_name", "similarity", "rank").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_layered_count(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.5), (1, 1.0), (2, 0.0), (2, 0.4), (3, 0.5), (4, None)], "k int, w double")
    got = D.layered_count(df, ["k"], F.col("w"), 0.5).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 2), (3, 1), (4, 1)]


def test_prices_among_rivals(spark):
    rng = np.random.default_rng(8)
    rows = [(int(e), "ab"[int(m)], None if p < 3 else int(p)) for e, m, p in zip(rng.integers(0, 12, 150), rng.integers(0, 2, 150), rng.integers(0, 40, 150), strict=True)] + [(1, "c", None)]
    near = [(s, (s + k) % 12) for s in range(12) for k in (1, 2, 5)]
    offers, rivals = spark.createDataFrame(rows, "entity long, method string, price long"), spark.createDataFrame(near, "subject long, rival long")
    x = pd.DataFrame(rows, columns=["rival", "method", "price"]).merge(pd.DataFrame(near, columns=["subject", "rival"]), on="rival")
    g = x.groupby(["subject", "method"]).agg(n=("rival", "size"), rivals=("rival", "nunique"), low=("price", "min"), high=("price", "max"), median=("price", "median")).reset_index()
    got = D.prices_among(offers, rivals)
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    pd.testing.assert_frame_equal(got.toPandas().sort_values(["subject", "method"]).reset_index(drop=True), g, check_dtype=False)


@pytest.mark.parametrize("name", ["adaptive_identity", "coherence_guard", "dedup_closest", "market_price", "result_rows", "report_driver"])
def test_chain_of_a_crowd(spark, crowd, name):
    assert differences(spark, pricing.QUERIES[name], pricing.ORACLES[name], crowd) == ""


@pytest.mark.parametrize("name", ["adaptive_identity", "coherence_guard", "dedup_closest", "market_price", "result_rows"])
def test_pairs_of_the_chain_are_no_arrays(spark, name):
    """Pairs of a service were one array, for which all of them were sorted on disk."""
    assert "collect_list(struct(o_minutes" not in pricing.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_rows(spark, crowd, monkeypatch):
    monkeypatch.setattr(pricing, "MET", 20)
    a, b = pricing.sides(spark, crowd, ["minutes"])
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() > 8
