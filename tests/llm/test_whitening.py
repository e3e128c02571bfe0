"""Whitening against a plain decomposition."""

import math
from decimal import Decimal

import numpy as np
import pytest

from textloom.llm.whitening import covariance, whitened

SCHEMA = "vec_id long, embedding array<double>, x string, at int, n int"


def plain(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, S = len(x), x.sum(0)
    dev = [int(sum((n * a - s) ** 2 for a, s in zip(row, S))) for row in x]
    c = (x - np.array([Decimal(int(s)) / n for s in S])).astype(float)
    V = c.T @ c / n
    e, axes = np.linalg.eigh(V)
    return n, dev, V, e[::-1], c @ axes[:, ::-1]


@pytest.mark.parametrize("d,width", [(70, 32), (7, 3), (1, 32)])
def test_against_a_plain_decomposition(spark, d, width):
    rng = np.random.default_rng(d)
    v = (rng.normal(size=(900, d)) * np.linspace(0.2, 2, d) + 3).tolist()
    v += [v[0]] * 300  # repeated rows count each
    rows = [(i, x, "clash", 1, 2) for i, x in enumerate(v)]
    bad = [(5000, None, "", 1, 1), (5001, [None] * d, "", 1, 1), (5002, [float("nan")] * d, "", 1, 1), (5003, [float("-inf")] * d, "", 1, 1), (5004, [1.0] * (d + 1), "", 1, 1), (5005, [], "", 1, 1)]
    df = spark.createDataFrame([*rows, *bad], SCHEMA).repartition(5)
    got = whitened(df, "vec_id", "embedding", width=width, rows=100).toPandas()
    n, dev, V, e, projected = plain(v)
    k = min(32, d)
    assert len(got) == n * k and set(got.n) == {n} and set(got.component) == set(range(1, k + 1))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    want = projected[:, :k] / np.sqrt(e[:k])
    sign = np.sign((wide * want).sum(0))
    assert np.abs(wide - want * sign).max() < 1e-6
    first = got[got.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == dev
    share = got[got.vec_id == 0].sort_values("component").explained.to_numpy()
    assert np.abs(share / (e[:k] / e.sum()) - 1).max() < 1e-9
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


def test_tiles_make_the_covariance(spark):
    rng = np.random.default_rng(1)
    x = (rng.integers(-(10**6), 10**6, (500, 11)) + 1_000_000).tolist()
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x)], "at long, x array<long>").repartition(3)
    sums = [sum(r[k] for r in x) for k in range(11)]
    got = covariance(df, 11, 500, sums, width=4, rows=64)
    want = np.cov(np.array(x, float).T, bias=True)
    assert np.abs(got - want).max() < 1e-3 and np.abs(got - got.T).max() == 0


def test_tables_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for t in (df, df.limit(1), df.limit(0)):
        assert whitened(t, "vec_id", "embedding").count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], "vec_id long, embedding array<double>")
    got = whitened(line, "vec_id", "embedding").toPandas()
    assert set(got.component) == {1} and got.identity_error.max() < 1e-9 and abs(got.explained.iloc[0] - 1) < 1e-12


def test_large_integers(spark):
    v = [[2.0**40], [-(2.0**40)], [0.0]]
    got = whitened(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), "vec_id", "embedding").orderBy("vec_id").collect()
    assert [g.deviation for g in got] == [None, None, 0]  # (3 * 2**46)**2 is no long
    assert abs(got[0].whitened) == pytest.approx(math.sqrt(1.5))
