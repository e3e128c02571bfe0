"""Rewards over batches: null keys, columns of clashing names, batches of one row."""

import math

import pytest

from textloom.operators import rewards as R


def test_scores_of_batches(spark):
    rows = [("a", 1, 1.0, 2.0, "x"), ("a", 2, 3.0, 2.0, "x"), (None, 3, 5.0, 1.0, "x"), (None, 4, 9.0, 3.0, "x"), ("c", 5, 7.0, 7.0, "x")]
    df = spark.createDataFrame(rows, "batch string, id int, u double, v double, mean0 string").repartition(3)
    got = {r.id: r for r in R.combined_rewards(df, ["batch"], {"u": 0.5, "v": 1.0}).collect()}
    assert len(got) == 5 and got[1].asDict().keys() == {"batch", "id", "u", "v", "mean0", "reward"}
    assert [round(got[i].reward, 9) for i in range(1, 6)] == [-1.0, 1.0, -1.0, 1.0, 0.0]
    scores = {r.id: r.z for r in R.with_scores(df, ["batch"], {"z": "v"}).collect()}
    assert scores == {1: 0.0, 2: 0.0, 3: -1.0, 4: 1.0, 5: 0.0}


def test_lengths_of_batches(spark):
    df = spark.createDataFrame([("a", "xx", True, 1), ("a", "xxxx", True, 2), ("a", "xxxx", False, 3), ("a", "xx", False, 4), (None, "x", None, 5)], "b string, text string, correct boolean, low int")
    got = {r.low: r.reward for r in R.length_rewards(df, ["b"]).collect()}
    assert got == {1: 0.5, 2: -0.5, 3: -0.5, 4: 0.0, 5: 0.0}
    assert R.length_rewards(df.limit(0), ["b"]).count() == 0


def test_moments_add_up(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id", "cast(id * id % 97 AS double) AS x")
    got = R.with_scores(df, ["k"], {"z": "x"}).groupBy("k").agg({"z": "avg"}).collect()
    assert all(abs(r[1]) < 1e-9 for r in got) and len(got) == 3
    assert math.isclose(sum(r.z**2 for r in R.with_scores(df, ["k"], {"z": "x"}).where("k = 0").collect()) / 334, 1, rel_tol=1e-9)
    with pytest.raises(Exception):
        R.with_scores(df, ["none"], {"z": "x"}).count()
