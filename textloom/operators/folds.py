"""Greedy runs over an ordered table: an exact sequential fold by composing functions of blocks.

A run takes rows while their sizes fit a budget; the row that does not fit begins the next run. What a block of rows does to
a fold that enters it depends on one number only, the size of the run that is open: the block is a piecewise linear
function from that number to the size open at its end (add the block's total while nothing breaks, else a constant that
the first break decides). Functions are composed block by block in groups, groups of groups, and so on; then the open
sizes are handed down the same tree, and each block folds its own rows. No block closes a run that goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import table, unused
from ..ship import ship
from .preparation import indexed

#: f(x) = slope[k] * x + value[k] for the last k with lo[k] <= x.
Step = tuple[np.ndarray, np.ndarray, np.ndarray]


def _at(f: Step, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.searchsorted(f[0], x, "right") - 1
    return f[1][k], f[1][k] * x + f[2][k]


def _shortest(lo: np.ndarray, slope: np.ndarray, value: np.ndarray) -> Step:
    keep = np.ones(len(lo), bool)
    keep[1:] = (slope[1:] != slope[:-1]) | (value[1:] != value[:-1])
    return lo[keep], slope[keep], value[keep]


def next_runs(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums up to each row, and the row that begins the next run after a run that begins at each row."""
    sums = np.cumsum(sizes)
    return sums, np.maximum(np.searchsorted(sums, sums - sizes + budget, "right"), np.arange(1, len(sizes) + 1))


def block_step(sizes: np.ndarray, budget: int) -> Step:
    """The function of a block; sizes over the budget count as budget + 1."""
    n = len(sizes)
    sums, after = next_runs(sizes, budget)
    left = np.minimum(sums[-1] - sums + sizes, budget + 1).tolist()  # open at the end if the last run begins at the row
    after_ = after.tolist()
    for p in range(n - 1, -1, -1):
        if after_[p] < n:
            left[p] = left[after_[p]]
    first = int(np.searchsorted(sums, budget, "right"))  # the first break if nothing is open
    p = np.arange(min(first, n - 1), -1, -1)
    lo, slope, value = np.maximum(budget - sums[p] + 1, 0), np.zeros(len(p), np.int64), np.array(left, np.int64)[p]
    if first == n:
        lo, slope, value = np.r_[0, lo], np.r_[1, slope], np.r_[sums[-1], value]
    last = np.append(lo[1:] != lo[:-1], True)  # of breaks from one size on, the earliest row
    return _shortest(lo[last], slope[last], value[last])


def compose(f: Step, g: Step) -> Step:
    """g after f."""
    lo, slope, value = f
    ends = np.append(lo[1:], np.iinfo(np.int64).max)
    cuts = [lo]
    for k in np.flatnonzero(slope):
        inner = g[0] - value[k]
        cuts.append(inner[(inner > lo[k]) & (inner < ends[k])])
    at = np.unique(np.concatenate(cuts))
    s, y = _at(f, at)
    t, z = _at(g, y)
    return _shortest(at, s * t, z - s * t * at)


_STEP = "block long, lo array<long>, slope array<long>, value array<long>"


def _packed(block: int, f: Step) -> pa.Table:
    return pa.table({"block": pa.array([block], pa.int64()), **{c: pa.array([x.tolist()], pa.list_(pa.int64())) for c, x in zip(("lo", "slope", "value"), f, strict=True)}})


def _steps(t: pa.Table) -> Iterator[tuple[int, Step]]:
    for r in sorted(t.to_pylist(), key=lambda r: r["block"]):
        yield r["block"], tuple(np.array(r[c], np.int64) for c in ("lo", "slope", "value"))


def _up(fan: int):
    def run(t: pa.Table) -> pa.Table:
        whole = None
        for block, f in _steps(t):
            whole = f if whole is None else compose(whole, f)
        return _packed(block // fan, whole)

    return run


def _down(t: pa.Table) -> pa.Table:
    """The functions of a group and the size that is open before the first -> the size before each."""
    open_ = t["open"][0].as_py()
    blocks, found = [], []
    for block, f in _steps(t):
        blocks.append(block)
        found.append(open_)
        open_ = int(_at(f, np.array([open_]))[1][0])
    return pa.table({"block": pa.array(blocks, pa.int64()), "open": pa.array(found, pa.int64())})


def greedy_runs(rows: DataFrame, order: list[str | Column], size: str, budget: int, out: str = "run", block: int = 65_536, fan: int = 256) -> DataFrame:
    """Numbers greedy runs of ``rows`` in an order from 0 (adds ``out``): a run ends before the row with which its sizes would exceed ``budget``.

    A row of more than the budget is a run of its own; sizes are whole and not negative, null counts as 0. Equal rows are taken
    one after another; an empty table stays empty. ``block`` rows at a time are in one task, and ``fan`` functions of blocks;
    results do not depend on either.
    """
    ship(rows.sparkSession)
    (at,) = unused([*rows.columns, out], "at")
    numbered = indexed(rows, order, at)
    sizes = numbered.select(F.floor(F.col(at) / block).alias("block"), F.col(at).alias("at"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"))

    def function(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        return _packed(t["block"][0].as_py(), block_step(t["size"].to_numpy(), budget))

    levels = [table(sizes.groupBy("block").applyInArrow(function, _STEP), "functions")]
    while levels[-1].count() > fan:
        levels.append(table(levels[-1].groupBy(F.floor(F.col("block") / fan)).applyInArrow(_up(fan), _STEP), "functions"))
    # before the first row anything is too full: the first row begins a run
    opened = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("block"), F.lit(budget + 1).cast("long").alias("open"))
    for level in reversed(levels):
        parents = level.withColumn("parent", F.floor(F.col("block") / fan))
        both = parents.join(opened.withColumnRenamed("block", "parent"), "parent")
        opened = table(both.groupBy("parent").applyInArrow(_down, "block long, open long"), "opened")

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        sizes_ = t["size"].to_numpy()
        sums, after = next_runs(sizes_, budget)
        new = np.zeros(len(sizes_), np.int64)
        p, after = int(np.searchsorted(sums, budget - t["open"][0].as_py(), "right")), after.tolist()
        while p < len(new):
            new[p] = 1
            p = after[p]
        return pa.table({"block": t["block"], "at": t["at"], "fresh": pa.array(np.cumsum(new))})

    runs = table(sizes.join(opened, "block").groupBy("block").applyInArrow(fold, "block long, at long, fresh long"), "runs")
    counts = runs.groupBy("block").agg(F.max("fresh").alias("n"))  # one row for each block
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    found = runs.join(counts, "block").select(F.col("at").alias(at), (F.col("before") + F.col("fresh") - 1).alias(out))
    return numbered.join(found, at).select(*(F.col(f"`{c}`") for c in rows.columns), out)
