"""Rules of the price chain and of verdicts on cases worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from marketloom import catalogue
from marketloom.functions import exprs as X
from marketloom.functions.params import params_agree, typed_params
from marketloom.operators import pricing as P

AGREE = [
    ("Filler 0,5 ml", "Filler 0.5ml", 1), ("Filler 0,5 ml", "Filler 2 ml", -1), ("Filler 1 ml", "Filler 1.0 ml lips", 1), ("Filler", "Filler 1 ml", 0),
    ("5 paznokci", "5 paznokcie", 1), ("5 paznokci", "10 paznokci", -1), ("5 zabiegów", "5 okolic", -1), ("2. 3 partie", "3 partie", 1),
    ("Lashes 2:1", "Lashes 2D", 1), ("Lashes 1:1", "Lashes 2:1", -1), ("Lashes 3D", "Lashes 3/4D", 1), ("Lashes 2D", "Lashes 3/4D", -1), ("Lashes 4 D", "Lashes 4/3d", 1),
    ("refill do 3 tyg", "refill po 4 tygodniach", -1), ("refill 3 tyg", "refill do 3 tygodni", 1), ("długość 1-2", "dlugosc 2", 1), ("długość 1-2", "długość 3", -1),
    ("3D do 3 tyg", "3:1 do 4 tyg", -1), ("Lashes 2:1", "Filler 1 ml", 0), ("1 ml 2D", "1 ml 3D", -1), ("1 ml 2D", "1 ml do 3 tyg", 1), (None, "1 ml", 0), ("", "", 0),
]


def test_typed_parameters(spark):
    df = spark.createDataFrame(AGREE, "a string, b string, want int").withColumn("got", params_agree(typed_params(F.col("a")), typed_params(F.col("b"))))
    assert [(r.a, r.b, r.got) for r in df.collect()] == AGREE
    one = spark.range(1).select(typed_params(F.lit("💉 3/4D, 0,5 ml - 2 zabiegi, długość 3-1")).alias("p")).first().p
    assert {k: (v.low, v.high, v.unit) for k, v in one.items()} == {
        "ml": (0.5, 0.5, ""), "count": (2.0, 2.0, "zabieg"), "volume": (3.0, 4.0, ""), "length": (1.0, 3.0, ""),
    }


SAMPLE = "subject string, s_params string, o_params string, s_package boolean, o_package boolean, s_area array<string>, o_area array<string>, s_words array<string>, o_words array<string>, s_minutes int, o_minutes int, s_price long, o_price long, o_entity long, o_id string"


def sample(subject="s", s_name="", o_name="", package=(False, False), area=((), ()), words=((), ()), minutes=(40, 40), price=(100, 100), entity=1):
    return (subject, s_name, o_name, *package, *map(list, area), *map(list, words), *minutes, *price, entity, f"o{entity}")


def typed(spark, rows):
    df = spark.createDataFrame(rows, SAMPLE)
    return df.withColumns({c: typed_params(F.col(c)) for c in ("s_params", "o_params")})


def test_votes_and_margins(spark):
    cases = [
        (sample(price=(100, 400)), (0, 0, 0, 0, 0, -1), -1.5),  # per minute a factor of 4
        (sample(price=(100, 399)), (0, 0, 0, 0, 0, 0), 0.0),
        (sample(price=(100, 400), minutes=(10, 40)), (0, 0, 0, 0, -1, 0), -0.5),  # four times as long at the same rate
        (sample(price=(100, 400), minutes=(0, 40)), (0, 0, 0, 0, 0, -1), -1.5),  # minutes unknown: raw prices
        (sample(price=(0, 400)), (0, 0, 0, 0, 0, 0), 0.0),
        (sample(words=(("hair", "care"), ("hair",))), (0, 0, 0, 1, 0, 0), 0.4),
        (sample(words=(("hair",), ("nails",))), (0, 0, 0, -1, 0, 0), -0.4),
        (sample(words=(("hair",), ())), (0, 0, 0, 0, 0, 0), 0.0),
        (sample(s_name="1 ml", o_name="1,0 ml"), (1, 0, 0, 0, 0, 0), 1.0),
        (sample(package=(False, True), area=(("face",), ("face", "neck"))), (0, -1, -1, 0, 0, 0), -2.0),
    ]
    got = P.votes(typed(spark, [c[0] for c in cases])).withColumn("margin", P.margin(F.lit(False))).collect()
    names = ["vote_params", "vote_package", "vote_area", "vote_category", "vote_duration", "vote_price"]
    assert [(tuple(r[n] for n in names), r.margin) for r in got] == [(v, m) for _, v, m in cases]
    weights = P.votes(typed(spark, [cases[5][0]])).select(*[P.margin(F.lit(g).cast("boolean")).alias(str(g)) for g in (True, False, None)]).first()
    assert tuple(weights) == (2.0, 0.4, 0.6)


def test_price_by_minutes(spark):
    of = lambda s, price, minutes, entity, own=40, package=False: sample(s, price=(15000, price), minutes=(own, minutes), entity=entity, package=(False, package))
    rows = [of("timed", p, m, k) for k, (p, m) in enumerate([(9900, 60), (10000, 60), (11000, 55), (8500, 30), (12000, 60)])]
    rows += [of("timed", 70000, None, 8, package=True), of("timed", 65000, None, 9, package=True), of("timed", 1, None, 10)]
    rows += [of("raw", p, m, k, own=None) for k, (p, m) in enumerate([(100, 10), (300, None), (200, 20), (401, 5)])]
    rows += [of("none timed", p, None, k) for k, p in enumerate([100, 200, 301])]
    rows += [of("few", 100, 40, 1), of("few", 200, 40, 2), of("packages", 100, 40, 1, package=True), of("packages", 100, 40, 2, package=True), of("packages", 1, 40, 3, package=True)]
    got = {r.subject: r for r in P.price(typed(spark, rows)).collect()}
    t = got["timed"]  # rates 165, 166.67, 200, 200, 283.33 a minute: median 200; prices 6600, 6667, 8000, 8000, 11333
    assert (t.market_price, t.market_p25, t.market_p50, t.market_p75, t.n_offers, t.n_entities, t.status) == (8000, 6667, 8000, 8000, 6, 8, "full")
    assert (t.deviation_pct, t.action, t.rate_median) == (87.5, "lower", 200.0)
    r = got["raw"]
    assert (r.market_price, r.market_p25, r.market_p75, r.rate_median, r.status) == (250, 175, 325, None, "thin")
    assert got["none timed"].market_price == 200
    few = got["few"]
    assert (few.status, few.market_price, few.deviation_pct, few.market_p50, few.action) == ("insufficient", None, None, 150, "hold")
    assert (got["packages"].market_price, got["packages"].n_offers, got["packages"].n_entities) == (None, 0, 3)
    rows = {r.subject: r for r in P.result_rows(P.price(typed(spark, rows))).collect()}
    assert (rows["few"].verification, rows["few"].action, rows["few"].market_low, rows["few"].percentile) == ("subject_only", "subject_only", None, None)
    t = rows["timed"]  # own rate 375 a minute against 200
    assert (t.verification, t.action, t.market_low, t.market_high, t.percentile, t.own_rate, t.rate_deviation_pct) == ("verified", "lower", 6667, 8000, 100.0, 375, 87.5)


def test_rerun_once_a_report(spark):
    run = lambda rows: spark.createDataFrame(rows, "subject string, verification string, action string, market_price long")
    ok, alone = lambda s, p: (s, "verified", "hold", p), lambda s: (s, "subject_only", "subject_only", None)
    strict = run([ok("a1", 1), alone("a2"), alone("b1"), alone("c1")])
    wide = run([ok("a1", 9), ok("a2", 9), ok("b1", 9), alone("c1")])
    services = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "b2"), ("c", "c1")], "report string, subject string")
    got = {r.subject: (r.widened, r.verification, r.market_price) for r in P.rerun_if_few(strict, wide, services).collect()}
    assert got == {"a1": (False, "verified", 1), "a2": (False, "subject_only", None), "b1": (True, "verified", 9), "b2": (True, "subject_only", None), "c1": (False, "subject_only", None)}


CASES = [
    (lambda r, f, p, e, a, b: X.bucket_v2(r, f, p, e, a, b), [
        ((19, 1.0, 1.0, 1.0, 1.0, 0.0), "new"), ((20, 0.25, 0.0, 0.85, 0.0, 0.0), "direct"), ((20, 0.0, 0.7, 0.85, 0.0, 0.0), "direct"), ((20, 0.25, 0.0, 0.84, 0.0, 0.0), "cluster"),
        ((20, 0.12, 0.0, 0.0, 0.0, 0.0), "cluster"), ((20, 0.11, 0.4, 0.0, 0.0, 0.0), "cluster"), ((20, 0.0, 0.0, 0.7, 0.9, 0.6), "aspirational"), ((20, 0.0, 0.0, 0.69, 0.9, 0.5), None),
        ((20, 0.0, 0.0, 0.9, None, 0.5), None), ((20, 0.0, 0.0, 0.9, 0.7, 0.5), None)]),
    (lambda s, c, m, n: X.score_cap(s, c, m, n), [
        ((97, 0, 0, 0), 88), ((97, 0, 0, 2), 88), ((97, 0, 1, 1), 85), ((97, 2, 1, 3), 75), ((97, 3, 0, 3), 60), ((40, 3, 0, 3), 40), ((86, 0, 0, 1), 86)]),
    (lambda p, s, r, d: X.verify_status(p == 1, s, r, d), [
        ((1, 0.1, 9.0, 0.0), "verified"), ((1, 0.9, 1.0, 5.0), "package_mismatch"), ((0, 0.79, 9.0, 5.0), "low_name_similarity"), ((0, 0.8, 2.1, 5.0), "duration_mismatch"),
        ((0, 0.8, 2.0, 5.0), "extreme_outlier"), ((0, None, None, -18.5), "extreme_outlier")]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_verdicts(spark, case):
    rule, cases = CASES[case]
    rows = [(k, *(None if v is None else float(v) for v in given)) for k, (given, _) in enumerate(cases)]
    names = [f"x{i}" for i in range(len(cases[0][0]))]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names))
    got = df.orderBy("k").select(rule(*map(F.col, names)).alias("got")).collect()
    assert [r.got for r in got] == [want for _, want in cases]


def test_extreme_flag_turns_three_statuses(spark):
    rows = [("verified", 151.0), ("method_targeted", -151.0), ("structured_direct", 160.0), ("subject_only", 400.0), ("verified", 150.0), ("verified", None)]
    df = spark.createDataFrame(rows, "status string, d double").select(X.extreme_flag(F.col("status"), F.col("d"), X.OPEN_STATUSES).alias("f"))
    assert [r.f for r in df.collect()] == ["extreme_outlier"] * 3 + ["subject_only", "verified", "verified"]


def test_pairs_of_the_chain_are_never_dealt_out(spark):
    """Offers are dealt out before they are compared; nothing above the explosion into pairs is a shuffle."""
    from marketloom.plans import pricing as plans

    chain = plans.P.price(plans.P.exploded(plans.P.kept_pool(plans.voted_pools(plans.pools(spark, "/root/testdata/sf0.001"))), *plans.KEYS, "s_price", "s_minutes"), plans.KEYS)
    above = chain._jdf.queryExecution().executedPlan().toString().rsplit("Generate inline", 1)[0]
    assert above.count("Generate inline") >= 1 and "Exchange" not in above


@pytest.mark.parametrize("name", ["action_a", "verify_status", "benchmarks_rollup"])
def test_medians_are_taken_from_counts(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(price" in plan and not re.search(r"percentile\(price#\d+L?, 0.5, 1,", plan)
