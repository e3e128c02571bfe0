"""Greedy runs against a plain fold, in all partitionings; interleaving against a plain draw."""

import hashlib
import random

import numpy as np
import pytest

from textloom.operators.folds import _at, block_step, compose, greedy_runs
from textloom.operators.preparation import drawn_places, interleave


def plain_runs(sizes, budget):
    run, open_, out = -1, budget + 1, []
    for n in sizes:
        if run < 0 or open_ + n > budget:
            run, open_ = run + 1, 0
        open_ += n
        out.append(run)
    return out


def test_functions_of_blocks():
    rng = np.random.default_rng(0)
    for _ in range(200):
        budget = int(rng.integers(1, 30))
        blocks = [rng.integers(0, rng.choice([2, 6, 40]), rng.integers(1, 25)) for _ in range(4)]
        whole = None
        for sizes in blocks:
            f = block_step(sizes, budget)
            whole = f if whole is None else compose(whole, f)
        for start in range(budget + 2):
            open_ = start
            for n in np.concatenate(blocks).tolist():
                open_ = min(n if open_ + n > budget else open_ + n, budget + 1)
            assert _at(whole, np.array([start]))[1][0] == open_


@pytest.mark.parametrize("block,fan,partitions", [(7, 2, 1), (50, 3, 7), (1000, 256, 3)])
def test_runs(spark, block, fan, partitions):
    rng = random.Random(block)
    sizes = [rng.choice([0, 0, 1, 3, 10, 25, 200]) for _ in range(1500)]
    df = spark.createDataFrame([(i, n, "clash", "clash") for i, n in enumerate(sizes)], "id long, n int, at string, block string").repartition(partitions)
    got = greedy_runs(df, ["id"], "n", 40, block=block, fan=fan)
    assert got.columns == [*df.columns, "run"]
    assert [r.run for r in got.orderBy("id").collect()] == plain_runs(sizes, 40)
    assert greedy_runs(df.limit(0), ["id"], "n", 40).count() == 0


def test_a_million_rows_are_one_fold(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1_000_000).select("id", F.pmod(F.xxhash64("id"), F.lit(37)).alias("n"))
    sizes = [r.n for r in rows.orderBy("id").collect()]
    got = greedy_runs(rows, ["id"], "n", 20_000)
    assert [r.run for r in got.orderBy("id").select("run").collect()] == plain_runs(sizes, 20_000)


def plain_draws(sizes, probs, first, seed):
    """One place after another, as a stream is drawn."""
    bounds, n, at, out, done = np.cumsum(probs) / sum(probs), [0] * len(sizes), 0, [], set()
    while True:
        u = int(hashlib.md5(f"{at}|{seed}".encode()).hexdigest()[:8], 16) / 2**32
        part = min(int(np.searchsorted(bounds, u, "right")), len(sizes) - 1)
        out.append((at, part, n[part]))
        n[part] += 1
        if n[part] >= sizes[part]:
            done.add(part)
        if done if first else len(done) == sum(q > 0 for q in probs):
            return out
        at += 1


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("sizes,probs", [([40, 3, 200], [0.2, 0.05, 0.75]), ([1, 500], [0.01, 0.99]), ([5, 5], [1.0, 0.0]), ([1], [2.0])])
def test_every_place(spark, sizes, probs, first):
    got = sorted(map(tuple, drawn_places(spark, sizes, probs, first, seed=7, block=64).collect()))
    assert got == plain_draws(sizes, probs, first, 7)


def test_a_rare_part_is_waited_for(spark):
    a, b = spark.range(1).toDF("id"), spark.range(100, 110).toDF("id")
    for seed in range(6):
        got = interleave([a, b], ["id"], "interleave_over", [0.001, 0.999], seed=seed).collect()
        assert 0 in {r.id for r in got} and sorted(r._at for r in got) == list(range(len(got)))


def test_columns_of_the_parts_stay(spark):
    a, b = spark.createDataFrame([(1, 7, 8, 9)], "id long, _at long, _part int, _i long"), spark.createDataFrame([(2, 7, 8, 9)], "id long, _at long, _part int, _i long")
    for strategy in ("concat", "interleave_over"):
        got = interleave([a, b], ["id"], strategy).orderBy("id").collect()
        assert [(r.id, r._at, r._part, r._i, r["__at"], r["__part"]) for r in got] == [(1, 7, 8, 9, 0, 0), (2, 7, 8, 9, 1, 1)]
    with pytest.raises(ValueError):
        interleave([a, b], ["id"], "interleave_over", [0.0, 0.0])
