"""N-gram decontamination and repetition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, normalize, word_ngrams
from ..shared import table


#: So many distinct n-grams of evaluation texts (some 100 bytes each) are broadcast; more are joined by shuffles.
BROADCAST_GRAMS = 2_000_000


def ngram_set(evals: DataFrame, text: str = "text", n: int = 8) -> DataFrame:
    """(gram): the distinct n-grams of an evaluation set."""
    return evals.select(F.explode_outer(word_ngrams(normalize(F.col(text)), n)).alias("gram")).where("gram is not null").distinct()


def flag_contaminated(rows: DataFrame, evals: DataFrame, key: str, text: str = "text", n: int = 8, flag: str = "contaminated") -> DataFrame:
    """``rows`` with a flag: an n-gram of its text is in the evaluation set.

    The evaluation side is counted: up to ``BROADCAST_GRAMS`` n-grams it goes to all executors, and a row's n-grams are looked
    up where they are; only keys of rows that have one are shuffled. Beyond that both sides are dealt by a 64-bit hash of the n-gram
    (texts decide). Texts shorter than n words are clean.
    """
    wanted = table(ngram_set(evals, n=n), "ngrams")
    grams = rows.select(key, F.explode_outer(F.array_distinct(word_ngrams(normalize(F.coalesce(F.col(text), F.lit(""))), n))).alias("gram")).where("gram is not null")
    if wanted.count() <= BROADCAST_GRAMS:
        hit = grams.join(F.broadcast(wanted), "gram", "left_semi")
    else:
        hit = grams.withColumn("h", F.xxhash64("gram")).join(wanted.withColumn("h", F.xxhash64("gram")), ["h", "gram"], "left_semi")
    hit = hit.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(hit, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def drop_contaminated(rows: DataFrame, prefix: str = "contaminated") -> DataFrame:
    """Rows with any flag go, then the flags."""
    flags = [c for c in rows.columns if c.startswith(prefix)]
    return rows.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in flags], F.lit(False))).drop(*flags)


def repetition_penalty(text: Column, n: int, penalty: float, language: str = "en") -> Column:
    """(1 - distinct / all n-grams) * penalty; 0 for an empty or short text. A positive penalty is an error.

    Words of ``en`` are divided by white space; of ``zh`` each character is one. For words of a learnt dictionary see
    :func:`~.words.repetition_of_words`.
    """
    if language not in ("en", "zh"):
        raise ValueError(f"unknown language {language}")
    if language == "zh":
        text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\S)", "$1 ")
    if penalty > 0:
        raise ValueError(f"the penalty {penalty} should not be positive")
    grams = word_ngrams(F.lower(F.coalesce(text, F.lit(""))), n)
    return let(grams, lambda g: F.when(F.size(g) > 0, (1 - F.size(F.array_distinct(g)) / F.size(g)) * penalty).otherwise(F.lit(0.0)))
