"""Evaluation metrics and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def length_cdf(rows: DataFrame, length: Column, interval: int) -> DataFrame:
    """(bucket, n, running, percent): how many rows have a length below the end of each occupied bucket."""
    counts = rows.select((F.floor(length / interval) * interval).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("running", F.sum("n").over(w)).withColumn("percent", F.col("running") / total * 100)


def category_accuracy(rows: DataFrame, category: str, predicted: str, label: str) -> DataFrame:
    """Percent right by category, and over all as ``Average``."""
    hit = F.avg((F.col(predicted) == F.col(label)).cast("int")) * 100
    both = rows.rollup(category).agg(hit.alias("accuracy"), F.count("*").alias("n"), F.grouping(category).alias("_all"))
    return both.select(F.when(F.col("_all") == 1, F.lit("Average")).otherwise(F.col(category)).alias(category), "accuracy", "n")


def smooth(values: Column) -> Column:
    """Exponential moving average of an array; the weight of the past grows with the length of the series."""
    n = F.size(values)
    weight = 1.8 * (1 / (1 + F.exp(-0.05 * n)) - 0.5)
    start = F.struct(F.array().cast("array<double>").alias("out"), F.element_at(values, 1).cast("double").alias("last"))

    def step(a: Column, x: Column) -> Column:
        now = a["last"] * weight + (1 - weight) * x
        return F.struct(F.concat(a["out"], F.array(now)).alias("out"), now.alias("last"))

    return F.when(n > 0, F.aggregate(values, start, step, lambda a: a["out"])).otherwise(F.array().cast("array<double>"))


def token_accuracy(predicted: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of labels that the prediction one place before gets right, ignored labels left out; null without any."""
    p, t = F.slice(predicted, F.lit(1), F.size(predicted) - 1), F.slice(labels, F.lit(2), F.size(labels) - 1)
    hits = F.filter(F.zip_with(p, t, lambda a, b: F.when(b != ignore, (a == b).cast("int"))), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(hits, F.lit(0), lambda a, x: a + x).cast("double"), F.size(hits).cast("double"))


def pairwise_accuracy(rows: DataFrame, chosen: str, rejected: str) -> DataFrame:
    return rows.agg(F.avg((F.col(chosen) > F.col(rejected)).cast("int")).alias("accuracy"))


def perplexity(losses: Column, mask: Column) -> Column:
    """exp of the mean loss of the tokens that count."""
    some = F.filter(F.zip_with(losses, mask, lambda x, m: F.when(m > 0, x)), lambda x: x.isNotNull())
    return F.exp(F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + x), F.size(some).cast("double")))


def sequence_logps(logps: Column, labels: Column, ignore: int = -100) -> Column:
    """struct<logp, n>: sum of the log-probabilities of labels that count, and their number."""
    some = F.filter(F.zip_with(logps, labels, lambda x, t: F.when(t != ignore, x)), lambda x: x.isNotNull())
    return F.struct(F.aggregate(some, F.lit(0.0), lambda a, x: a + x).alias("logp"), F.size(some).alias("n"))


def debiased_logp(logps: Column, labels: Column, public: Column, alpha: float, ignore: int = -100) -> Column:
    """The sum of log-probabilities in which tokens from place ``public`` (from 0) on count ``alpha`` times."""
    some = F.zip_with(logps, labels, lambda x, t: F.when(t != ignore, x))
    weighed = F.transform(some, lambda x, i: F.coalesce(F.when(i < public, x).otherwise(x * alpha), F.lit(0.0)))
    return F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x)


def mean_of_means(rows: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """The means over batches of each batch's means, nulls left out: how a trainer logs what its steps report."""
    steps = rows.groupBy(batch).agg(*(F.avg(c).alias(c) for c in columns))
    return steps.agg(*(F.avg(c).alias(c) for c in columns))


def _log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-F.abs(x))) + F.least(x, F.lit(0.0))


def pairwise_loss(chosen: Column, rejected: Column) -> Column:
    return -_log_sigmoid(chosen - rejected)


def odds_ratio_loss(chosen: Column, rejected: Column, beta: float) -> Column:
    """Likelihood of the chosen text and the logistic of the odds ratio; inputs are mean log-probabilities."""
    odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return -chosen - beta * _log_sigmoid(odds)


def margin_loss(chosen: Column, rejected: Column, beta: float, gamma: float) -> Column:
    """Logistic of the difference of mean log-probabilities less a margin."""
    return -_log_sigmoid(beta * (chosen - rejected - gamma / beta))


def side_means(rows: DataFrame, side: str, value: str) -> DataFrame:
    """Means of the desired and the other side and their difference; Spark adds partial sums and counts."""
    means = rows.agg(F.avg(F.when(F.col(side), F.col(value))).alias("chosen"), F.avg(F.when(~F.col(side), F.col(value))).alias("rejected"))
    return means.withColumn("margin", F.col("chosen") - F.col("rejected"))


def valid_ratio(labels: Column, ignore: int = -100) -> Column:
    return F.size(F.filter(labels, lambda x: x != ignore)) / F.size(labels)


def learning_rate(valid_tokens: Column, base: float = 3e-4, base_tokens: float = 4_000_000.0) -> Column:
    """Square-root scaling of a rate with the tokens of a batch that are learnt."""
    return base * F.sqrt(valid_tokens / base_tokens)


def _overlap(a: list[str], b: list[str], n: int) -> float:
    x, y = (pd.Series([tuple(t[i : i + n]) for i in range(len(t) - n + 1)], dtype=object).value_counts() for t in (a, b))
    common = sum(min(c, y.get(g, 0)) for g, c in x.items())
    return 2 * common / (x.sum() + y.sum()) if common else 0.0


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, int)
    for x in a:
        new = row.copy()
        for j, y in enumerate(b):
            new[j + 1] = row[j] + 1 if x == y else max(new[j], row[j + 1])
        row = new
    return int(row[-1])


def _bleu(ref: str, hyp: str, method3: bool = True) -> float:
    """BLEU-4 of characters; an order without matches counts half as much as the one before it."""
    if not ref or not hyp:
        return 0.0
    total, halving = 0.0, 1
    for n in range(1, 5):
        x, y = ([t[i : i + n] for i in range(len(t) - n + 1)] for t in (hyp, ref))
        counts = pd.Series(x).value_counts() if x else {}
        have = pd.Series(y).value_counts() if y else {}
        hits = sum(min(c, have.get(g, 0)) for g, c in counts.items())
        if n == 1 and not hits:
            return 0.0
        size = max(len(x), 1)
        if hits:
            p = hits / size
        else:
            halving *= 2
            p = 1 / (halving * size)
        total += np.log(p) / 4
    return float((1 if len(hyp) > len(ref) else np.exp(1 - len(ref) / len(hyp))) * np.exp(total))


def similarity(rows: DataFrame, predicted: str, label: str, words: tuple[str, str] | None = None) -> DataFrame:
    """Adds rouge_1, rouge_2, rouge_l (F of words, per cent) and bleu_4 (characters, per cent), rounded to 4 places; empty texts have 0.

    ``words``: columns with the words of both texts (see :func:`~.words.with_words`); else they are divided by white space.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            cut = (lambda c: [[] if w is None else list(w) for w in b[c]]) if words else (lambda c: [t.split() for t in b[c].fillna("")])
            sides = map(cut, words or (predicted, label))
            for p, t, h, r in zip(b[predicted].fillna(""), b[label].fillna(""), *sides, strict=True):
                if not h or not r:
                    out.append((0.0, 0.0, 0.0, 0.0))
                    continue
                both = _common(h, r)
                f = 2 * both / (len(h) + len(r))
                out.append((100 * _overlap(h, r, 1), 100 * _overlap(h, r, 2), 100 * f, 100 * _bleu(t, p)))
            b[["rouge_1", "rouge_2", "rouge_l", "bleu_4"]] = np.round(np.array(out, float).reshape(-1, 4), 4)
            yield b

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType(rows.schema.fields + [StructField(c, DoubleType()) for c in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")])
    return rows.mapInPandas(score, schema)


def progress(rows: DataFrame, step: str, total: str, elapsed: str, tokens: str) -> DataFrame:
    """Adds percent done, seconds left and tokens a second to log rows."""
    return rows.withColumns({"percent": F.round(F.col(step) / F.col(total) * 100, 2), "seconds_left": F.when(F.col(step) > 0, F.col(elapsed) / F.col(step) * (F.col(total) - F.col(step))), "tokens_per_second": F.try_divide(F.col(tokens).cast("double"), F.col(elapsed).cast("double"))})
