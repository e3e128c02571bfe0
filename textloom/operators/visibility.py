"""How visible each source document is in a generated answer, from citation-weighted words and positions.

An answer is cut into sentences; each gives its weight to the documents it cites. The divisor is the
number of all citations of the sentence, repeats and unknown documents included, so part of the
weight can be lost before the scores are divided by their sum. Without any score every slot has 1 / n.
The row form keeps one answer in one row (no shuffle); :func:`impressions_long` is the exploded form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citations, n_long_words, sentences
from ..shared import unused

KINDS = ("wordpos", "word", "pos")


def cited_sentences(text: Column, split: Column | None = None) -> Column:
    """array<struct<words, cites>> of an answer, in order; ``split``: its sentences, where they are known."""
    return F.transform(sentences(text) if split is None else split, lambda s: F.struct(n_long_words(s).alias("words"), citations(s).alias("cites")))


def with_impressions(answers: DataFrame, text: str = "text", out: str = "scores", n: int = 5, split: str | None = None) -> DataFrame:
    """Adds ``out``: array<struct<slot, wordpos, word, pos>> of n slots, each kind summing to 1. A null text has uniform scores.

    ``split``: a column with each answer's sentences, as :func:`~.sentences.with_sentences` makes it; else a fixed rule splits.

    Sentences, raw scores and totals are columns of their own, so none is computed twice. (Unfold the result with
    explode_outer: explode adds a filter on the array, which Spark pushes below and computes once more.)
    """
    sents, raw, totals = unused([*answers.columns, out], "sents", "raw", "totals")
    rows = answers.withColumn(sents, cited_sentences(F.coalesce(F.col(text), F.lit("")), None if split is None else F.col(split)))
    last = (F.size(sents) - 1).cast("double")
    cites = F.flatten(F.transform(sents, lambda s, i: F.transform(s["cites"], lambda c: F.struct(c.alias("slot"), s["words"].alias("words"), i.alias("i"), F.size(s["cites"]).alias("c")))))
    rows = rows.withColumn(raw, F.filter(cites, lambda c: (c["slot"] >= 0) & (c["slot"] < n)))

    def weight(c: Column, kind: str) -> Column:
        decay = F.when(last > 0, F.exp(-c["i"] / last)).otherwise(F.lit(1.0))
        return {"wordpos": c["words"] * decay, "word": c["words"].cast("double"), "pos": decay}[kind] / c["c"]

    def sums(slot: Column | None) -> Column:
        mine = F.col(raw) if slot is None else F.filter(raw, lambda c: c["slot"] == slot)
        zero = F.struct(*(F.lit(0.0).alias(k) for k in KINDS))
        return F.aggregate(mine, zero, lambda a, c: F.struct(*((a[k] + weight(c, k)).alias(k) for k in KINDS)))

    rows = rows.withColumn(totals, sums(None))
    slots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("slot"), sums(k).alias("s")))
    total = F.col(totals)
    share = lambda x, k: F.when(total[k] > 0, x["s"][k] / total[k]).otherwise(F.lit(1.0 / n))
    scores = F.transform(slots, lambda x: F.struct(x["slot"].alias("slot"), *(share(x, k).alias(k) for k in KINDS)))
    return rows.withColumn(out, scores).drop(sents, raw, totals)


def impressions_long(answers: DataFrame, n: int = 5) -> DataFrame:
    """(key, slot, wordpos, word, pos): the same scores from exploded citations; answers: key, text."""
    sents = answers.select("key", F.posexplode(cited_sentences(F.col("text"))).alias("i", "s"))
    sizes = answers.select("key", F.size(sentences(F.col("text"))).alias("size"))
    rows = answers.select("key", F.size(sentences(F.coalesce("text", F.lit("")))).alias("size"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    cites = sents.join(sizes, "key").select("key", "i", "size", "s.words", F.size("s.cites").alias("c"), F.explode("s.cites").alias("slot")).where(F.col("slot") < n)
    decay = F.when(F.col("size") > 1, F.exp(-F.col("i") / (F.col("size") - 1))).otherwise(F.lit(1.0))
    sums = cites.groupBy("key", "slot").agg(F.sum(F.col("words") * decay / F.col("c")).alias("wordpos"), F.sum(F.col("words") / F.col("c")).alias("word"), F.sum(decay / F.col("c")).alias("pos"))
    every = rows.join(sums, ["key", "slot"], "left").na.fill(0.0, list(KINDS))
    totals = every.groupBy("key").agg(*(F.sum(k).alias(f"t_{k}") for k in KINDS))
    shares = [F.when(F.col(f"t_{k}") > 0, F.col(k) / F.col(f"t_{k}")).otherwise(F.lit(1.0 / n)).alias(k) for k in KINDS]
    return every.join(totals, "key").select("key", "slot", *shares)


def target_score(scores: Column, target: Column) -> Column:
    """The scores of one slot; a target out of range has none of anything."""
    zero = F.struct(F.lit(-1).alias("slot"), *(F.lit(0.0).alias(k) for k in KINDS))
    return F.when((target >= 0) & (target < F.size(scores)), F.get(scores, target)).otherwise(zero)


def best_worst(scores: Column) -> Column:
    """struct<best, worst>: slots of the largest and smallest sum of the three scores; the first of equals."""
    sums = F.transform(scores, lambda s: F.round(s["wordpos"] + s["word"] + s["pos"], 9))
    return F.struct((F.array_position(sums, F.array_max(sums)) - 1).alias("best"), (F.array_position(sums, F.array_min(sums)) - 1).alias("worst"))


def splice(texts: Column, target: Column, text: Column) -> Column:
    """``texts`` with the target's text replaced; a target out of range changes nothing."""
    return F.transform(texts, lambda x, i: F.when(i == target, text).otherwise(x))


def source_block(texts: Column, closed: bool = False) -> Column:
    """The documents as blocks for a prompt, numbered from 0 as citations are; ``closed``: a blank line follows the last, too. A null text is empty."""
    blocks = F.transform(texts, lambda t, i: F.concat(F.lit("### Source "), i.cast("string"), F.lit(":\n"), F.coalesce(t, F.lit(""))))
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n\n" if closed else ""))


def mean_scores(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The mean of each column by group, nulls left out."""
    return scores.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))


def scores_with_fallback(records: DataFrame, score: str, text: str, original: str = "original") -> DataFrame:
    """The scores to average: of a record whose text is empty the original's instead; records without the score are left out."""
    empty = F.coalesce(F.col(text) == "", F.lit(False))
    return records.where(F.col(score).isNotNull()).withColumn(score, F.when(empty, F.col(original)).otherwise(F.col(score))).where(F.col(score).isNotNull())
