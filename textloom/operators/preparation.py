"""Sampling, mixing, splitting, resuming: every choice is by a keyed hash, so it repeats however rows are partitioned."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import table, unused


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def take_fraction(rows: DataFrame, key: str, weight: float, seed: int = 42) -> DataFrame:
    """Exactly floor(n * weight) rows after a seeded shuffle; top-n is taken from each partition first."""
    n = int(rows.count() * weight)
    return rows.orderBy(shuffle_key(key, seed), key).limit(n)


def take(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def page(rows: DataFrame, order: list[str], number: int, size: int = 2) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def exact_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows: a permutation cut at n, or all rows and then draws with replacement."""
    size = rows.count()
    if size == 0 or n <= size:
        return rows.orderBy(shuffle_key(key, seed), key).limit(n)
    (at,) = unused(rows.columns, "at")
    draws = rows.sparkSession.range(n - size).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size)).alias(at))
    numbered = indexed(rows, [key], at)
    return rows.unionByName(numbered.join(draws, at).drop(at))


def indexed(rows: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Numbers rows from 0 in an order (adds ``out``); which of equal rows comes first is open.

    Rows are ranged, sorted and written once to the shared folder with their partition and their place in it: what is
    counted is then what is numbered, however the ranges fall. The counts are one row for each partition.
    """
    at, part, first = unused([*rows.columns, out], "at", "part", "first")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = table(ranged.withColumn(at, F.monotonically_increasing_id()), "indexed")  # partition << 33 | place
    counts = placed.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*").alias(first))
    before = counts.select(part, (F.sum(first).over(Window.orderBy(part)) - F.col(first)).alias(first))
    both = placed.join(F.broadcast(before), F.shiftright(at, 33) == F.col(part))
    return both.withColumn(out, F.col(first) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, first)


def split(rows: DataFrame, key: str, test: float | int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """train, test: an exact number (or share, rounded up) of rows for the test, by shuffled rank."""
    n = test if isinstance(test, int) else math.ceil(rows.count() * test)
    picked = rows.select(key).orderBy(shuffle_key(key, seed), key).limit(n)
    return rows.join(picked, key, "left_anti"), rows.join(picked, key, "left_semi")


def split_stream(rows: DataFrame, order: list[str], test: int, validation: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The first ``test`` rows of an order as validation and those after them as train, as a stream is taken and skipped; further validation sets
    by name (``validation_{name}``)."""
    if validation and test:
        raise ValueError("give a size for validation or sets for it, not both")
    out = {f"validation_{k}": v for k, v in (validation or {}).items()}
    if not test:
        return {"train": rows} | out
    return {"validation": rows.orderBy(*order).limit(test), "train": rows.orderBy(*order).offset(test)} | out


def qualified(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of keys."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


@dataclass(frozen=True)
class Part:
    """A data set of a mixture."""

    rows: DataFrame
    weight: float | None = None
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Mixture:
    """Weighted parts with the same columns, shuffled, perhaps split."""

    parts: list[Part]
    key: str
    seed: int = 42
    test: float | None = None
    _: None = field(default=None, repr=False)

    def __post_init__(self):
        if not self.parts:
            raise ValueError("a mixture needs parts")
        sets = {frozenset(p.columns or p.rows.columns) for p in self.parts}
        if len(sets) > 1:
            raise ValueError(f"column names must be the same in all parts: {sorted(map(sorted, sets))}")

    def build(self) -> dict[str, DataFrame]:
        some = []
        for p in self.parts:
            rows = p.rows.select(*p.columns) if p.columns else p.rows
            some.append(take_fraction(rows, self.key, p.weight, self.seed) if p.weight is not None else rows)
        whole = reduce(DataFrame.unionByName, some)
        if self.test is None:
            return {"train": whole.orderBy(shuffle_key(self.key, self.seed), self.key)}
        train, test = split(whole, self.key, self.test, self.seed)
        return {"train": train, "test": test}


def draw(place: Column, probs: list[float], seed: int) -> Column:
    """The part that a place draws: 32 bits of a seeded hash against the running sums of the probabilities."""
    u = F.conv(F.substring(F.md5(F.concat(place.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    drawn = F.lit(len(probs) - 1)
    for i in reversed(range(len(probs) - 1)):
        drawn = F.when(u < sum(probs[: i + 1]) / sum(probs), F.lit(i)).otherwise(drawn)
    return drawn.cast("int")


def drawn_places(spark: SparkSession, sizes: list[int], probs: list[float], first: bool, seed: int = 42, block: int = 1 << 17) -> DataFrame:
    """(at, part, n): what each place draws and how often the part was drawn before, up to the place that uses up the ``first`` part or the last one.

    Draws are counted for each block of places; running sums of the counts tell in which block a part is drawn for the last time
    that it needs, and only this block is looked through. Blocks are added, as many again each time, until the end is among
    them. Parts of probability 0 are never drawn and not waited for.
    """
    wanted = [i for i, q in enumerate(probs) if q > 0]
    most = max(sizes[i] * sum(probs) / probs[i] for i in wanted)
    blocks = max(1, math.ceil(most / block))
    places = lambda a, z: spark.range(a * block, z * block).select(F.col("id").alias("at"), draw(F.col("id"), probs, seed).alias("part"))
    number = F.floor(F.col("at") / block).alias("block")
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts, have = None, 0
    size = F.element_at(F.array(*(F.lit(n).cast("long") for n in sizes)), F.col("part") + 1)
    while True:
        more = places(have, blocks).groupBy(number, "part").agg(F.count("*").alias("n"))
        counts = table(more if counts is None else counts.unionByName(more), "draws")
        sums = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        ends = {r.part: r for r in sums.where((F.col("before") < size) & (F.col("before") + F.col("n") >= size)).collect()}  # one row for each part
        if len(ends) == len(wanted) or first and ends:
            break
        have, blocks = blocks, blocks * 2
    last = []
    for part, r in ends.items():
        mine = places(r.block, r.block + 1).where(F.col("part") == part).orderBy("at").offset(sizes[part] - r.before - 1).limit(1)
        last.append(mine.first().at)
    end = min(last) if first else max(last)
    within = Window.partitionBy("block", "part").orderBy("at")
    drawn = places(0, end // block + 1).where(F.col("at") <= end).withColumn("block", number).withColumn("k", F.row_number().over(within) - 1)
    return drawn.join(F.broadcast(sums.drop("n")) if blocks * len(probs) <= 1 << 16 else sums.drop("n"), ["block", "part"]).select("at", "part", (F.col("before") + F.col("k")).alias("n"))


def interleave(parts: list[DataFrame], order: list[str], strategy: str = "interleave_under", probs: list[float] | None = None, seed: int = 42) -> DataFrame:
    """Rows of the parts in turn, with _at (place) and _part; more underscores where the parts have such columns.

    ``concat``: one after another. ``interleave_under`` stops with the first part that is used up,
    ``interleave_over`` goes on until all are, starting the shorter ones again. With ``probs`` each place
    draws its part by a seeded hash, until the last row that the strategy waits for is placed. Without a row in one of the parts
    nothing can be interleaved: the result is empty.
    """
    if strategy not in ("concat", "interleave_under", "interleave_over"):
        raise ValueError(f"unknown strategy {strategy}")
    sizes = [p.count() for p in parts]
    spark, k = parts[0].sparkSession, len(parts)
    at, part, i = unused(parts[0].columns, "_at", "_part", "_i")
    rows = reduce(DataFrame.unionByName, [indexed(p, order, i).withColumn(part, F.lit(j)) for j, p in enumerate(parts)])
    if strategy == "concat":
        first = F.element_at(F.array(*(F.lit(sum(sizes[:j])).cast("long") for j in range(k))), F.col(part) + 1)
        return rows.withColumn(at, F.col(i) + first).drop(i)
    if 0 in sizes:
        return rows.withColumn(at, F.col(i)).drop(i).limit(0)
    if probs is None:
        rounds = min(sizes) if strategy == "interleave_under" else max(sizes)
        places = spark.range(rounds * k).select(F.col("id").alias("at"), (F.col("id") % k).cast("int").alias("part"), F.floor(F.col("id") / k).alias("n"))
    else:
        if len(probs) != k:
            raise ValueError("one probability for each part")
        if min(probs) < 0 or not sum(probs):
            raise ValueError("probabilities are not negative, and not all 0")
        places = drawn_places(spark, sizes, probs, strategy == "interleave_under", seed)
    size = F.element_at(F.array(*(F.lit(n).cast("long") for n in sizes)), F.col("part") + 1)
    places = places.select(F.col("at").alias(at), F.col("part").alias(part), (F.col("n") % size).alias(i))
    return places.join(rows, [part, i]).drop(i)


def resume(rows: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the tables of finished keys."""
    return rows.join(reduce(DataFrame.unionByName, [d.select(key) for d in done]).distinct(), key, "left_anti")


def hashed_id(column: Column) -> Column:
    return F.md5(column.cast("string"))


def batches(rows: DataFrame, order: list[str], size: int = 1000, out: str = "batch") -> DataFrame:
    """Numbers runs of ``size`` rows; a size below 1 makes one batch."""
    if size < 1:
        return rows.withColumn(out, F.lit(0).cast("long"))
    (at,) = unused([*rows.columns, out], "at")
    return indexed(rows, order, at).withColumn(out, F.floor(F.col(at) / size)).drop(at)


def running(rows: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each name in ``sums``, the sum of its column over the rows before in an order; 0 for the first.

    Ranges as in :func:`indexed`: each is summed where it is, and one row for each range carries the sums on.
    """
    at, part = unused([*rows.columns, *sums], "at", "part")
    placed = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "running")
    placed = placed.withColumn(part, F.shiftright(at, 33))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(*(F.sum(c).alias(out) for out, c in sums.items())).select(part, *(F.coalesce(F.sum(out).over(earlier), F.lit(0)).alias(out) for out in sums))
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{at}{i}") for i, c in enumerate(sums.values())))
    both = inner.join(F.broadcast(starts), part)
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), *((F.col(out) + F.col(f"{at}{i}")).alias(out) for i, out in enumerate(sums)))


def index_range(rows: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (excluded) in an order."""
    (at,) = unused(rows.columns, "at")
    return indexed(rows, order, at).where((F.col(at) >= start) & (F.col(at) < end)).drop(at)


def preference_pair(good: Column, bad: Column, key: Column) -> Column:
    """struct<document_a, document_b, winner>: the good document is first for half of the keys, by hash."""
    first = F.substring(F.md5(key.cast("string")), 1, 1) < "8"
    return F.struct(F.when(first, good).otherwise(bad).alias("document_a"), F.when(first, bad).otherwise(good).alias("document_b"), F.when(first, "A").otherwise("B").alias("winner"))


def required(rows: DataFrame, columns: list[str], quota: int | None = None, order: list[str] | None = None, counts_skipped: bool = True) -> DataFrame:
    """Rows that have all columns, at most ``quota``; rows left out use up the quota too unless ``counts_skipped`` is false."""
    if quota is not None and counts_skipped:
        rows = rows.orderBy(*order).limit(quota)
    rows = rows.dropna(subset=columns)
    return rows.orderBy(*order).limit(quota) if quota is not None and not counts_skipped else rows


@dataclass(frozen=True)
class DataArguments:
    """Options that must fit together."""

    val_size: float = 0.0
    streaming: bool = False
    max_samples: int | None = None
    interleave_probs: tuple[float, ...] | None = None
    n_datasets: int = 1
    mix_strategy: str = "concat"
    mask_history: bool = False
    train_on_prompt: bool = False
    max_steps: int = -1
    eval_dataset: str | None = None
    packing: bool = False
    neat_packing: bool = False

    def __post_init__(self):
        if self.interleave_probs is not None:
            if self.mix_strategy == "concat":
                raise ValueError("probabilities are for interleaving")
            if len(self.interleave_probs) != self.n_datasets:
                raise ValueError("one probability for each data set")
        if self.streaming and 1e-6 < self.val_size < 1:
            raise ValueError("streaming needs a whole number for val_size")
        if self.eval_dataset is not None and self.val_size > 1e-6:
            raise ValueError("val_size does not go with eval_dataset")
        if self.neat_packing and not self.packing:
            raise ValueError("neat_packing needs packing")
        if self.streaming and self.max_samples is not None:
            raise ValueError("max_samples does not go with streaming")
        if self.streaming and self.max_steps < 1:
            raise ValueError("streaming needs max_steps")
        if self.mask_history and self.train_on_prompt:
            raise ValueError("mask_history does not go with train_on_prompt")
