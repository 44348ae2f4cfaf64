"""Stages of the pipeline on null ids, repeated rows and ids with several texts."""

import collections

import pytest

from marketloom.llm import common, mixing, near_dedup, quality_rules


def text(k, n=40):
    return " ".join(f"w{k}x{i}" for i in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int")


def test_keyed(spark):
    rows = [(None, text(0)), (None, text(0)), (None, None), (2, text(1)), (2, text(2)), (1, text(1))]
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    numbered, key = common.keyed(docs)
    got = sorted(numbered.collect(), key=lambda r: r[key])
    assert key == "_row" and [r[key] for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r.doc_id for r in got] == [1, 2, 2, None, None, None] and rows_of(numbered) == collections.Counter(rows)
    assert common.keyed(docs.filter("doc_id = 1"))[1] == "doc_id"


def test_keep_good_by_row(spark, labels):
    good = [(None, text(0), "s"), (3, text(1), "s"), (4, text(2), "s"), (4, text(2), "s"), (None, text(3), "s")]
    bad = [(None, "too short", "s"), (3, "short too", "s"), (None, None, "s")]
    kept = quality_rules.keep_good(frame(spark, good + bad), labels)
    assert kept.columns == ["doc_id", "text", "source"] and rows_of(kept) == collections.Counter((i, t) for i, t, _ in good)


def test_keep_one_by_row(spark):
    a, b, c = text(0), text(1), text(2)
    near = b + " more"
    docs = [(None, a, "s"), (None, a, "s"), (None, c, "s"), (5, b, "s"), (5, text(3), "s"), (3, near, "s"), (7, text(4), "s"), (7, text(4), "s")]
    kept = near_dedup.keep_one(frame(spark, docs))
    # One of the two null-id copies, the near copy with the smaller id, and the other text of id 5.
    assert rows_of(kept) == collections.Counter([(None, a), (None, c), (3, near), (5, text(3)), (7, text(4))])


def test_mixed_by_row(spark):
    rows = [(None, text(k), "s") for k in range(10)] + [(1, text(20), "s")] * 10 + [(2, text(30 + k), "s") for k in range(10)] + [(50 + k, text(50 + k), "s") for k in range(10)]
    docs = frame(spark, rows)
    times = rows_of(mixing.mixed(docs))
    have = collections.Counter((i, t) for i, t, _ in rows)
    # One source at 1.5 times its size: each row is taken once or twice, and 40 equal rows give 60.
    assert set(times) == set(have) and all(n <= times[k] <= 2 * n for k, n in have.items())
    assert sum(times.values()) == 60
    assert rows_of(mixing.mixed(docs.repartition(7))) == times
