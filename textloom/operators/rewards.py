"""Rewards of completions: Column expressions for single rows, DataFrame functions for batches.

REWARDS names the row rewards; :func:`register` adds others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import unused
from .contamination import repetition_penalty

REWARDS: dict[str, Callable[..., Column]] = {}


def register(name: str):
    def add(f):
        if name in REWARDS:
            raise ValueError(f"reward {name} exists")
        REWARDS[name] = f
        return f

    return add


@register("len")
def short(text: Column) -> Column:
    return -F.length(text)


@register("format")
def thought_then_answer(text: Column) -> Column:
    """1 if a thought and an answer, each on lines of its own, stand at the start."""
    return text.rlike(r"(?smd)\A<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>$").cast("double")


@register("tag_count")
def tag_count(text: Column, weight: float = 0.335) -> Column:
    """``weight`` for each tag that occurs exactly once."""
    once = lambda tag: (F.size(F.split(text, tag, -1)) == 2).cast("double") * weight
    return once("<think>\n") + once("\n</think>\n") + once("\n<answer>\n") + once("\n</answer>")


@register("reasoning_steps")
def reasoning_steps(text: Column, enough: int = 3) -> Column:
    """Numbered steps, list items and words of order, up to ``enough``. A number counts as a list item at the start of the text only."""
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"(?U)(Step \d+:|\A\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)")) / enough)


@register("cosine")
def cosine(text: Column, correct: Column, longest: int = 1000, wrong: tuple[float, float] = (-1.0, -0.5), right: tuple[float, float] = (0.5, 1.0)) -> Column:
    """A cosine of the length: short right answers earn most, long wrong ones lose least. ``correct`` null: nothing to compare with, 1."""
    wave = 1.0 + F.cos(F.length(text) / longest * math.pi)
    up = lambda low, high: F.lit(low) + 0.5 * (high - low) * wave
    return F.when(correct.isNull(), F.lit(1.0)).when(correct, up(*right)).otherwise(up(wrong[1], wrong[0]))


@register("repetition_penalty")
def repetition(text: Column, n: int = 3, penalty: float = -1.0, language: str = "en") -> Column:
    return repetition_penalty(text, n, penalty, language)


@register("soft_overlong_punishment")
def overlong(tokens: Column, longest: int = 16384, cache: int = 4096) -> Column:
    """0 up to ``longest - cache`` tokens, falling to -1 at ``longest``, then -1."""
    return F.when(tokens <= longest - cache, F.lit(0.0)).when(tokens <= longest, (F.lit(longest - cache) - tokens) / cache).otherwise(F.lit(-1.0))


@register("code_format")
def code_format(text: Column, language: Column) -> Column:
    """As :func:`thought_then_answer`, with a fenced block of the row's language in the answer."""
    pattern = F.concat(F.lit(r"(?smd)\A<think>\n.*?\n</think>\n<answer>\n.*?```"), language, F.lit(r".*?```.*?\n</answer>$"))
    return F.regexp_like(text, pattern).cast("double")


@register("accuracy")
def accuracy(text: Column, solution: Column) -> Column:
    """Whether the answer is the solution: the last ``\\boxed{}`` or the whole, without spaces, dollar signs and a final dot; as numbers if both are. No solution: null. (No symbolic comparison.)"""

    def plain(x: Column) -> Column:
        boxed = F.try_element_at(F.regexp_extract_all(x, F.lit(r"\\boxed\{([^{}]*)\}"), F.lit(1)), F.lit(-1))
        return F.regexp_replace(F.coalesce(boxed, x), r"[\s$]+|\.$", "")

    a, b = plain(text), plain(solution)
    number = lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), x.try_cast("decimal(38,10)"))
    numbers = F.abs(number(a) - number(b)) < F.lit("0.000001").cast("decimal(38,10)")
    return F.when(b != "", (F.coalesce(numbers, F.lit(False)) | (a == b)).cast("double"))


def with_batch(rows: DataFrame, batch: list[str], **sums: Column) -> DataFrame:
    """Adds aggregates of each batch (null is a batch of its own): summed up where the rows are, and joined back, so that no task holds a batch.

    Names that ``rows`` has get underscores: they are the last columns, in order.
    """
    names = unused([*rows.columns, *batch], *sums)
    keys = unused([*rows.columns, *names], *(f"key{i}" for i in range(len(batch))))
    found = rows.groupBy(*(F.col(b).alias(k) for b, k in zip(batch, keys, strict=True))).agg(*(c.alias(n) for n, c in zip(names, sums.values(), strict=True)))
    same = F.lit(True)
    for b, k in zip(batch, keys, strict=True):
        same = same & rows[b].eqNullSafe(found[k])
    return rows.join(found, same).drop(*keys)


def length_rewards(rows: DataFrame, batch: list[str], text: str = "text", correct: str = "correct", out: str = "reward") -> DataFrame:
    """0.5 less the place of a text's length between the batch's shortest and longest; wrong answers earn nothing. Equal lengths: 0."""
    both = with_batch(rows, batch, low=F.min(F.length(text)), high=F.max(F.length(text)))
    low, high, n = F.col(both.columns[-2]), F.col(both.columns[-1]), F.length(text)
    value = 0.5 - (n - low) / (high - low)
    done = both.withColumn(out, F.when(high == low, F.lit(0.0)).when(F.coalesce(F.col(correct), F.lit(True)), value).otherwise(F.least(F.lit(0.0), value)))
    return done.drop(*both.columns[-2:])


def with_scores(rows: DataFrame, batch: list[str], scores: dict[str, str]) -> DataFrame:
    """Adds, for each name in ``scores``, the standard scores of its column with the batch's mean and population deviation; of a constant batch 0."""
    sums = {f"{k}{i}": f(c) for i, c in enumerate(scores.values()) for k, f in (("mean", F.avg), ("sd", F.stddev_pop))}
    both = with_batch(rows, batch, **sums)
    added = both.columns[len(rows.columns) :]
    value = lambda c, mean, sd: F.when(F.col(sd) > 0, (F.col(c) - F.col(mean)) / F.col(sd)).otherwise(F.lit(0.0))
    return both.withColumns({out: value(c, *added[2 * i : 2 * i + 2]) for i, (out, c) in enumerate(scores.items())}).drop(*added)


def combined_rewards(rows: DataFrame, batch: list[str], weights: dict[str, float], out: str = "reward") -> DataFrame:
    """Each column's standard scores, weighted and summed, and their standard scores again."""
    total, *names = unused([*rows.columns, out], "total", *(f"z{i}" for i in range(len(weights))))
    scored = with_scores(rows, batch, dict(zip(names, weights, strict=True)))
    scored = scored.withColumn(total, sum((F.col(n) * w for n, w in zip(names, weights.values(), strict=True)), F.lit(0.0))).drop(*names)
    return with_scores(scored, batch, {out: total}).drop(total)


def logged(rows: DataFrame, batch: list[str], column: str) -> DataFrame:
    """Mean and sample deviation of each batch; of one row 0."""
    return rows.groupBy(*batch).agg(F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std"))


def with_lookup(rows: DataFrame, lookup: DataFrame, solution: str = "solution", key: str = "query_id") -> DataFrame:
    """Rows with their record of the lookup; without one its columns are null (and the reward is 0: :func:`looked_up`)."""
    return rows.join(lookup, rows[solution].cast("string") == lookup[key].cast("string"), "left")


def looked_up(rows: DataFrame, lookup: DataFrame, reward: Column, solution: str = "solution", key: str = "query_id", out: str = "reward") -> DataFrame:
    """Adds ``out``: ``reward``, an expression over rows and their record of the lookup, or 0 where there is no record."""
    there = with_lookup(rows, lookup, solution, key)
    return there.select(*(rows[c] for c in rows.columns), F.when(lookup[key].isNotNull(), F.coalesce(reward, F.lit(0.0))).otherwise(F.lit(0.0)).alias(out))


def word_position_points(rows: DataFrame, batch: list[str], weights: dict[str, float], found: str = "found", out: str = "reward") -> DataFrame:
    """The reward of rewritten documents: :func:`combined_rewards` over the rows whose record was ``found``; the others have 0.

    The columns of ``weights`` are the raw scores (visibility gain, key points, rules followed); a missing one counts as 0.
    """
    good = rows.where(F.col(found)).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in weights})
    rest = rows.where(~F.coalesce(F.col(found), F.lit(False))).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in weights})
    return combined_rewards(good, batch, weights, out).unionByName(rest.withColumn(out, F.lit(0.0)))


def gathered_generations(generations: DataFrame, key: str, order: str, text: str = "generation", reward: str = "reward") -> DataFrame:
    """(key, generations, rewards): scored generations of each prompt as arrays in order; partial lists precede the shuffle."""
    lists = generations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(reward).cast("double").alias("r")))).alias("g"))
    return lists.select(key, F.transform("g", lambda x: x["t"]).alias("generations"), F.transform("g", lambda x: x["r"]).alias("rewards"))


def repeated_prompts(rows: DataFrame, k: int, out: str = "generation_id") -> DataFrame:
    """Each row ``k`` times, numbered from 0: one row for each generation to ask for."""
    return rows.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def execution_summary(runs: DataFrame, by: list[str], reward: str = "reward", seconds: str = "seconds") -> DataFrame:
    """Time and mean, least and greatest reward of each setting of an execution benchmark."""
    return runs.groupBy(*by).agg(F.max(seconds).alias("execution_time"), F.avg(reward).alias("mean_reward"), F.min(reward).alias("min_reward"), F.max(reward).alias("max_reward"))


def subtask_tests(subtasks: DataFrame, cases: DataFrame, runs: DataFrame) -> DataFrame:
    """The input of :func:`subtask_scores`: subtasks (submission, problem, subtask, points, digits, test_names) with their tests' cases
    (problem, test_name, ...) and what is known of their runs (submission, test_name, score, status).

    A name without a case is left out; a test that was not run has no score; of several runs of a test the best counts.
    """
    names = subtasks.select("submission", "problem", "subtask", "points", "digits", F.explode("test_names").alias("test_name"))
    best = runs.groupBy("submission", "test_name").agg(F.max_by(F.struct("score", "status"), F.struct("score", "status")).alias("run"))
    there = names.join(cases.select("problem", "test_name").distinct(), ["problem", "test_name"])
    return there.join(best, ["submission", "test_name"], "left").select("submission", "problem", "subtask", "points", "digits", "test_name", "run.score", F.coalesce("run.status", F.lit("SKIPPED")).alias("status"))


def visibility_gain(new: Column, old: Column, weight: float = 0.33) -> Column:
    """Weighted difference of the sums of two structs of scores."""
    total = lambda s: s["wordpos"] + s["word"] + s["pos"]
    return weight * total(new) - weight * total(old)


def points_reward(supported: Column, points: Column, least: float = 0.8) -> Column:
    return F.when(F.coalesce(F.try_divide(supported.cast("double"), points.cast("double")), F.lit(0.0)) >= least, 1.0).otherwise(0.0)


def rules_followed(answers: Column, rules: int = 15) -> Column:
    """Share of rules judged as followed; ``answers`` is a map of booleans."""
    return F.size(F.filter(F.map_values(answers), lambda v: v)) / rules


def pass_rate_filter(rows: DataFrame, rewards: str = "rewards", low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows whose mean reward, nulls left out, is strictly between the bounds; without any reward a row goes."""
    known = F.filter(rewards, lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double"))
    return rows.where((mean > low) & (mean < high))


def subtask_scores(tests: DataFrame) -> DataFrame:
    """(submission, subtask, score, weighted, status); tests: submission, subtask, points, digits, score, status (null score: not run, 0).

    A subtask has the score of its worst test, rounded, and the worst status by order.
    """
    order = {"CE": 0, "RE": 1, "WA": 2, "MLE": 3, "TLE": 4, "PA": 5, "AC": 6, "SKIPPED": 999}
    rank = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in order.items() for x in (F.lit(k), F.lit(v)))), F.col("status")), F.lit(999))
    rows = tests.groupBy("submission", "subtask").agg(F.min(F.coalesce("score", F.lit(0.0))).alias("low"), F.max("points").alias("points"), F.max("digits").alias("digits"), F.min_by("status", rank).alias("status"))
    rounded = lambda x: F.round(x * F.pow(F.lit(10.0), F.col("digits"))) / F.pow(F.lit(10.0), F.col("digits"))
    return rows.select("submission", "subtask", rounded(F.col("low")).alias("score"), rounded(F.col("low") * F.col("points")).alias("weighted"), "status")


def submission_score(passed: Column, total: Column, compiled: Column, code: Column, mode: str = "weighted_sum") -> Column:
    """Reward of a submission: no code -1, no compilation -0.1, no tests null; else all passed, the share passed, or all plus a tenth of the share."""
    if mode not in ("pass_fail", "partial", "weighted_sum"):
        raise ValueError(f"unknown mode {mode}")
    whole, share = (passed == total).cast("double"), passed / total
    value = {"pass_fail": whole, "partial": share, "weighted_sum": whole + 0.1 * share}[mode]
    return F.when(~code, F.lit(-1.0)).when(total == 0, F.lit(None).cast("double")).when(~compiled, F.lit(-0.1)).otherwise(value)


def binary(reward: Column, least: float = 0.99) -> Column:
    return (reward > least).cast("double")
