"""The inverted-file index against all pairs: exact by its bounds, few lists on clustered vectors, recall with limited probes."""

import numpy as np
import pytest

from marketloom.operators import vector_index as VI

SCHEMA = "id long, vector array<double>, list string, kth double"


def table(spark, rows, first=0):
    return spark.createDataFrame([(first + i, None if v is None else v.tolist(), "x", 0.0) for i, v in enumerate(rows)], SCHEMA).repartition(5)


def brute(queries, rows, k, floor, first=0):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    steps = np.rint(unit(queries) @ unit(rows).T * 10_000).astype(int)
    out = set()
    for i in range(len(queries)):
        order = [j for j in np.lexsort((np.arange(len(rows)), -steps[i])) if j != first + i and steps[i, j] >= floor * 10_000]
        out |= {(first + i, int(j), steps[i, j] / 10_000) for j in order[:k]}
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    return np.concatenate([c + rng.normal(size=(60, 16)) * 0.15 for c in centres] + [np.repeat(centres[:1], 70, 0), rng.normal(size=(40, 16))])


def test_exact_by_bounds(spark, tmp_path, clustered):
    path = f"file://{tmp_path}/index"
    VI.build(table(spark, clustered), path, size=40, most=50)
    held = spark.read.parquet(f"{path}/rows")
    assert held.count() == len(clustered) and held.groupBy("list").count().agg({"count": "max"}).first()[0] < 120
    got = VI.search(spark, table(spark, clustered[:200]), path, 6, first=2).collect()
    assert {tuple(r) for r in got} == brute(clustered[:200], clustered, 6, -1.0)
    got = VI.search(spark, table(spark, clustered[:200]), path, 4, floor=0.97, first=2).collect()
    assert {tuple(r) for r in got} == brute(clustered[:200], clustered, 4, 0.97)
    near = VI.search(spark, table(spark, clustered[:200]), path, 6, probes=3).collect()
    want = brute(clustered[:200], clustered, 6, -1.0)
    assert len({tuple(r) for r in near} & want) >= 0.95 * len(want)


def test_bounds_leave_far_lists_out(clustered):
    unit = VI.unit(clustered)
    centres = unit[::60][:12]
    own = np.argmax(unit @ centres.T, axis=1)
    reach = np.array([(unit @ centres.T)[own == c, c].min() for c in range(len(centres))])
    bound = VI.may_hold(unit, centres, reach)
    for c in range(len(centres)):
        assert (bound[:, c] >= (unit @ unit[own == c].T).max(1) - 1e-9).all()


def test_nulls_zeros_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = [np.array([1.0, 0.0]), None, np.zeros(2), np.array([2.0, 0.0]), np.array([0.0, 1.0])]
    VI.build(table(spark, rows), path)
    got = {tuple(r) for r in VI.search(spark, table(spark, rows), path, 1).collect()}
    assert got == {(0, 3, 1.0), (3, 0, 1.0), (4, 0, 0.0)}
    VI.build(table(spark, rows).limit(0), path)
    assert VI.search(spark, table(spark, rows), path, 1).count() == 0


def test_sample_sends_few_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector")).repartition(20)
    want = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(500).collect()]
    with monkeypatch.context() as m:
        m.setattr(type(rows), "limit", None)  # a limit has each of the tasks send 500 rows
        assert [r.id for r in VI.sampled(rows, 40_000, 500)] == want
    # Too small a bound grows; where all are asked for, or ids repeat, the same rows come.
    assert [r.id for r in VI.sampled(rows, 4_000_000, 500)] == want
    assert len(VI.sampled(rows, 400, 500)) == 500
    assert len(VI.sampled(rows.withColumn("id", F.col("id") % 3), 40_000, 500)) == 500
    assert VI.sampled(rows.limit(0), 0, 500) == []
