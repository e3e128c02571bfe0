"""Words of texts that are written without spaces: a dictionary learnt from the texts by aggregations, and the best path through each text's word graph.

A sequence of characters is a word if it is frequent, if its parts meet far oftener than they would by chance (cohesion), and
if what stands before and after it varies (freedom, the entropy of its neighbours). A word's probability is its share of all
occurrences; a text is cut where the product of the probabilities is highest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import let
from ..shared import table
from ..ship import ship

#: Runs of Chinese characters, as both Java and Python read it.
HAN = "[⺀-⿟々〇〡-〩㐀-䶿一-鿿豈-﫿𠀀-𯨟]+"


def _grams(run: Column, most: int) -> Column:
    """All substrings of 1 to ``most`` characters, with repeats."""
    none = F.array().cast("array<string>")

    def of(c: Column, shorter: Column, size: int) -> Column:
        """Those of ``size`` characters and more: each is one a character shorter and the next character, so that no place is searched for in the text."""
        both = F.zip_with(F.slice(shorter, F.lit(1), F.greatest(F.size(c) - size + 1, F.lit(0))), F.slice(c, F.lit(size), F.greatest(F.size(c) - size + 1, F.lit(0))), lambda a, b: F.concat(a, b))
        return let(F.when(F.size(c) >= size, both).otherwise(none), lambda x: x if size == most else F.concat(x, of(c, x, size + 1)))

    return let(F.array_remove(F.split(run, ""), ""), lambda c: c if most == 1 else F.concat(c, of(c, c, 2)))


def learn_words(docs: DataFrame, text: str = "text", runs: str = HAN, longest: int = 4, least: int = 5, share: float = 1e-6, cohesion: float = 20.0, freedom: float = 0.7) -> DataFrame:
    """(word, n, logp): all single characters of the runs and the words of 2 to ``longest`` characters.

    A word of two or more occurs ``least`` times and has ``share`` of all characters at least, so that there are at most ``longest`` / ``share``
    of them however many texts there are. cohesion: how much oftener than by chance the parts of a word meet, at its weakest place;
    freedom: the least entropy of what follows and of what precedes (an end of a run is like nothing else). Null texts have no runs.
    """
    found = docs.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(text, F.lit(runs), F.lit(0))).alias("run"))
    counts = table(found.select(F.explode(_grams(F.col("run"), longest + 1)).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "grams")
    size = F.length("word")
    total = counts.where(size == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = counts.where((size > 1) & (size <= longest) & (F.col("n") >= max(least, share * total)))
    # the weakest place
    parts = some.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    parts = parts.select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("a"), F.substring("word", F.col("k") + 1, F.length("word") - F.col("k")).alias("b"))
    left, right = counts.toDF("a", "na"), counts.toDF("b", "nb")
    met = parts.join(left, "a").join(right, "b").groupBy("word", "n").agg(F.min(F.col("n") * float(max(total, 1)) / F.col("na") / F.col("nb")).alias("cohesion"))

    def entropy(part: Column, name: str) -> DataFrame:
        longer = counts.where(size > 1).select(part.alias("word"), F.col("n").alias("k"))
        return longer.groupBy("word").agg(F.sum(F.col("k") * F.log("k")).alias(name))

    after, before = entropy(F.substring("word", F.lit(1), size - 1), "after"), entropy(F.substring("word", F.lit(2), size - 1), "before")
    free = met.where(F.col("cohesion") >= cohesion).join(after, "word", "left").join(before, "word", "left")
    varied = lambda c: F.log("n") - F.coalesce(F.col(c), F.lit(0.0)) / F.col("n")
    words = free.where((varied("after") >= freedom) & (varied("before") >= freedom)).select("word", "n")
    words = table(counts.where(size == 1).unionByName(words), "words")
    every = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return words.select("word", "n", F.log(F.col("n") / F.lit(float(max(every, 1)))).alias("logp"))


def trie(words: dict[str, float]) -> dict:
    """Nested dictionaries by character; the empty string holds a word's logarithm."""
    top: dict = {}
    for word, logp in words.items():
        node = top
        for c in word:
            node = node.setdefault(c, {})
        node[""] = logp
    return top


def best_path(run: str, top: dict, unknown: float) -> list[str]:
    """The words of the likeliest path; a character that is no word counts ``unknown``. Of equal paths the one whose later words are longer."""
    n = len(run)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for i in range(n):
        here = best[i]
        if here + unknown > best[i + 1] and "" not in top.get(run[i], {}):
            best[i + 1], back[i + 1] = here + unknown, i
        node = top
        for j in range(i, n):
            node = node.get(run[j])
            if node is None:
                break
            if "" in node and here + node[""] > best[j + 1]:
                best[j + 1], back[j + 1] = here + node[""], i
    out, at = [], n
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return out[::-1]


def with_words(rows: DataFrame, words: DataFrame, text: str = "text", out: str = "words", runs: str = HAN) -> DataFrame:
    """Adds ``out``: the words of each text in order; runs are cut by the dictionary ``words`` (:func:`learn_words`), other characters at white space.

    The dictionary, whose size is bounded where it is learnt, goes to each executor once. Null texts have null.
    """
    ship(rows.sparkSession)
    known = {r.word: r.logp for r in words.select("word", "logp").collect()}
    sent = rows.sparkSession.sparkContext.broadcast(known)
    unknown = min(known.values(), default=0.0) - 10.0
    pieces = re.compile(rf"({runs})|((?:(?!{runs})\S)+)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, seen = trie(sent.value), {}

        def cut(x: str) -> list[str]:
            if len(seen) > 100_000:
                seen.clear()
            if x not in seen:
                seen[x] = best_path(x, top, unknown)
            return seen[x]

        for b in batches:
            yield b.assign(**{out: [None if t is None else [w for m in pieces.finditer(t) for w in (cut(m[1]) if m[1] else [m[2]])] for t in b[text]]})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, ArrayType(StringType()))]))


def repetition_of_words(words: Column, n: int, penalty: float) -> Column:
    """(1 - distinct / all n-grams of words) * penalty; 0 for null, empty or fewer words. A positive penalty is an error."""
    if penalty > 0:
        raise ValueError(f"the penalty {penalty} should not be positive")

    def of(w: Column) -> Column:
        k = F.size(w) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.slice(w, i, F.lit(n)))
        return let(grams, lambda g: F.when(k > 0, (1 - F.size(F.array_distinct(g)) / F.size(g)) * penalty).otherwise(F.lit(0.0)))

    return let(F.coalesce(words, F.array().cast("array<string>")), of)
