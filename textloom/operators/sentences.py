"""Sentence splitting with a model learnt from the texts themselves (after Kiss and Strunk, 2006), by aggregations only.

A period ends a sentence unless it belongs to an abbreviation, an initial, a number or an ellipsis and what follows speaks
against it. Learnt are: abbreviations (types that nearly always have a period, the shorter and the more dotted the
likelier, by a likelihood ratio), how types are written after and inside sentences, words that start sentences, and pairs
that belong together across a period. The decision depends on (word before, word after, its case) only, so the model is the
table of the combinations whose period ends nothing; texts are joined with it, and split in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..shared import table, unused

# Fixed values of the method: the likelihood-ratio bounds, and the share of an abbreviation's occurrences that have a period.
ABBREVIATION, STARTER, COLLOCATION, DOTTED = 0.3, 30.0, 7.88, 0.99

_OPEN = r"""^["'“‘«„(\[{]+"""
#: Closing quotes and brackets, citations among them.
_SHUT = r"""(?:\[[^\w\s]*\d+[^\w\s]*\]|["'”’»)\]}])+$"""
_BLANK_LINE = r"\n[^\S\n]*\n"
_NUMBER = "##"
_ELLIPSIS = "…"


def chunks(text: Column) -> Column:
    """A text cut before each word; the parts joined are the text."""
    return F.split(text, r"(?<=\s)(?=\S)")


def token(chunk: Column) -> Column:
    """struct<base, mark, ends, case> of a chunk.

    base: lower case, without quotes, brackets and punctuation around it; numbers are one type. mark: ``.`` (one period), ``…``, ``!``
    (also for ``?``) or nothing. ends: a paragraph ends here. case: of the first character, ``U``, ``l`` or ``-``.
    """

    def of(core: Column) -> Column:
        base = F.lower(F.regexp_replace(core, r"[.,;:!?…]+$", ""))
        mark = F.when(core.rlike(r"[!?]$"), "!").when(core.rlike(r"(\.\.|…)$"), _ELLIPSIS).when(core.endswith("."), ".").otherwise("")
        case = F.when(core.rlike(r"^\p{Lu}"), "U").when(core.rlike(r"^\p{Ll}"), "l").otherwise("-")
        named = let(base, lambda b: F.when(b.rlike(r"^[+-]?\d[\d.,:/-]*$"), _NUMBER).otherwise(b))
        return F.struct(named.alias("base"), mark.alias("mark"), chunk.rlike(_BLANK_LINE).alias("ends"), case.alias("case"))

    return let(F.regexp_replace(F.regexp_replace(F.regexp_replace(chunk, r"\s+$", ""), _OPEN, ""), _SHUT, ""), of)


def tokens(text: Column) -> Column:
    """array<struct<base, mark, ends, case>> of the chunks (:func:`token`)."""
    return F.transform(chunks(text), token)


def _may_end(chunk: Column) -> Column:
    """False for chunks whose mark is empty and after which no paragraph ends; cheaper than their token."""
    return chunk.rlike(rf"[.!?…]|{_BLANK_LINE}")


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """k successes of n at probability p; a share of 0 or 1 is certain."""
    of = lambda count, share: F.when(count > 0, count * F.log(F.greatest(share, F.lit(1e-300)))).otherwise(0.0)
    return of(k, p) + of(n - k, 1 - p)


def likelihood_ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Dunning's ratio for b following a more often than b occurs at all; 0 if it does not."""
    p, p1, p2 = b / n, both / a, F.coalesce(F.try_divide(b - both, n - a), F.lit(0.0))
    ratio = -2 * (_log_likelihood(both, a, p) + _log_likelihood(b - both, n - a, p) - _log_likelihood(both, a, p1) - _log_likelihood(b - both, n - a, p2))
    return F.when(p1 > p, ratio).otherwise(0.0)


@dataclass(frozen=True)
class SentenceModel:
    """types: (base, n, dotted, abbreviation, starter); joined: (before, after, case) whose period ends no sentence."""

    types: DataFrame
    joined: DataFrame


def _type_counts(tokens_: DataFrame) -> DataFrame:
    """(base, n, dotted, abbreviation) of all types; tokens_: t and how often (k)."""
    types = table(tokens_.where("t.base <> ''").groupBy(F.col("t.base").alias("base")).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("t.mark") == ".", F.col("k")).otherwise(0)).alias("dotted")), "types")
    total = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("dotted"), F.lit(0)).alias("periods")).first()
    share = F.lit(total.periods / total.total if total.total else 0.0)
    ratio = -2 * (_log_likelihood(F.col("dotted"), F.col("n"), share) - _log_likelihood(F.col("dotted"), F.col("n"), F.lit(DOTTED)))
    inner = F.length("base") - F.length(F.replace("base", F.lit("."), F.lit("")))
    letters = F.length("base") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -(F.col("n") - F.col("dotted")).cast("double"))
    abbreviation = (F.col("dotted") > 0) & F.col("base").rlike(r"\p{L}") & (score >= ABBREVIATION)
    return types.withColumn("abbreviation", abbreviation)


def train(docs: DataFrame, text: str = "text") -> SentenceModel:
    """The model of all texts of ``docs``; null and empty texts say nothing, and without texts every period ends a sentence."""
    # equal chunks after equal ends are counted before anything is read from them; what surely ends nothing is blank, a start of a text null
    parts = F.array_compact(chunks(F.col(text)))
    seen = docs.where(F.col(text).isNotNull()).select(F.explode(let(parts, lambda c: F.transform(c, lambda x, i: F.struct(let(F.get(c, i - 1), lambda a: F.when(a.isNull() | _may_end(a), a).otherwise("")).alias("a"), x.alias("b"))))).alias("p"))
    seen = table(seen.groupBy("p.a", "p.b").agg(F.count("*").alias("k")), "sentence-chunks")
    begin = F.struct(F.lit("").alias("base"), F.lit("!").alias("mark"), F.lit(True).alias("ends"), F.lit("-").alias("case"))
    types = table(_type_counts(seen.groupBy("b").agg(F.sum("k").alias("k")).select(token(F.col("b")).alias("t"), "k")), "sentence-types")
    total = types.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = seen.select(F.struct(F.when(F.col("a").isNull(), begin).otherwise(token(F.col("a"))).alias("a"), token(F.col("b")).alias("b")).alias("p"), "k")
    dotted = F.col("p.a.mark").isin(".", _ELLIPSIS) & ~F.col("p.a.ends")
    before = F.when(dotted & (F.col("p.a.mark") == _ELLIPSIS), _ELLIPSIS).when(dotted, F.col("p.a.base"))  # null: surely an end, or surely none
    keys = [before.alias("before"), (~dotted & (F.col("p.a.ends") | (F.col("p.a.mark") == "!"))).alias("end"), F.col("p.b.base").alias("after"), F.col("p.b.case").alias("case")]
    pairs = pairs.groupBy(*keys).agg(F.sum("k").alias("k"))
    short = types.where("abbreviation").select(F.col("base").alias("before"), F.lit(True).alias("abbreviation"))
    pairs = pairs.join(short, "before", "left").withColumn("abbreviation", F.coalesce("abbreviation", F.col("before") == _ELLIPSIS, F.lit(False)))
    odd = F.coalesce(F.col("before").rlike(r"^\p{L}$") | (F.col("before") == _NUMBER), F.lit(False))
    pairs = pairs.withColumn("odd", odd).withColumn("end", F.when(F.col("before").isNull(), F.col("end")).otherwise(~F.col("abbreviation") & ~odd))
    pairs = table(pairs, "sentence-pairs")

    some = lambda condition, name: F.sum(F.when(condition, F.col("k")).otherwise(0)).alias(name)
    upper, lower = F.col("case") == "U", F.col("case") == "l"
    started = F.col("end") & F.col("before").isNotNull()
    words = pairs.where("after <> ''").groupBy("after").agg(some(upper, "upper"), some(upper & ~F.col("end"), "inside"), some(lower, "lower"), some(lower & F.col("end"), "begin_lower"), some(started, "started"))
    ends = pairs.agg(F.coalesce(some(started & (F.col("after") != ""), "x"), F.lit(0))).first()[0]
    counts = types.select(F.col("base").alias("after"), F.col("n").alias("n_after"))
    words = words.join(counts, "after")
    ratio = likelihood_ratio(F.lit(max(ends, 1)), F.col("n_after"), F.col("started"), F.lit(max(total, 1)))
    words = table(words.withColumn("starter", F.col("after").rlike(r"^\p{L}") & (F.col("started") > 0) & (ratio >= STARTER)), "sentence-words")

    held = pairs.where(F.col("before").isNotNull() & (F.col("abbreviation") | F.col("odd")))
    both = held.groupBy("before", "after").agg(F.sum("k").alias("both"))
    both = both.join(types.select(F.col("base").alias("before"), F.col("dotted").alias("n_before")), "before").join(counts, "after")
    ratio = likelihood_ratio(F.col("n_before"), F.col("n_after"), F.col("both"), F.lit(max(total, 1)))
    pair = both.where((F.col("both") > 1) & (ratio >= COLLOCATION)).select("before", "after", F.lit(True).alias("pair"))
    rows = held.join(words.drop("n_after", "started"), "after", "left").join(pair, ["before", "after"], "left")
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    breaks = upper & (at("lower") > 0) & (at("inside") == 0)
    joins = lower & ((at("upper") > 0) | (at("begin_lower") == 0))
    begins = breaks | upper & F.coalesce("starter", F.lit(False))
    name = F.col("before").rlike(r"^\p{L}$") & upper & ~breaks & (at("lower") == 0)
    ends_nothing = F.when(F.col("odd"), F.coalesce("pair", F.lit(False)) | joins | name | F.col("abbreviation") & ~begins).otherwise(~begins)
    joined = table(rows.where(ends_nothing).select("before", "after", "case").distinct(), "sentence-joins")
    starters = words.where("starter").select(F.col("after").alias("base"), "starter")
    return SentenceModel(types.join(starters, "base", "left").withColumn("starter", F.coalesce("starter", F.lit(False))), joined)


def with_sentences(rows: DataFrame, model: SentenceModel, text: str = "text", out: str = "sentences") -> DataFrame:
    """Adds ``out``: the sentences of each text in order, without white space around them; none of a null, empty or blank text.

    Ends are periods that the model does not rule out, ellipses likewise, exclamation and question marks, blank lines and the end of the
    text. Only periods that might go on are joined with the model.
    """
    key, held, parts = unused([*rows.columns, out], "key", "held", "parts")
    numbered = table(rows.withColumn(key, F.monotonically_increasing_id()), "texts")

    def asked(c: Column) -> Column:
        """Of each period or ellipsis that might go on: its place and what the model decides by. Only what may be an end, and what follows, is read."""
        of = lambda a, i: F.when(a["mark"].isin(".", _ELLIPSIS) & ~a["ends"], let(token(F.get(c, i + 1)), lambda b: F.struct(i.alias("i"), F.when(a["mark"] == ".", a["base"]).otherwise(_ELLIPSIS).alias("before"), b["base"].alias("after"), b["case"].alias("case"))))
        return F.array_compact(F.transform(c, lambda x, i: F.when((i < F.size(c) - 1) & _may_end(x), let(token(x), lambda a: of(a, i)))))

    open_ = numbered.select(key, F.explode(let(chunks(F.col(text)), asked)).alias("p")).select(key, "p.*")
    found = open_.join(model.joined, ["before", "after", "case"]).groupBy(key).agg(F.collect_list("i").alias(held))
    whole = numbered.join(found, key, "left").withColumn(parts, chunks(F.col(text)))
    last = F.size(parts) - 1
    end = lambda t, i: t["ends"] | (t["mark"] == "!") | t["mark"].isin(".", _ELLIPSIS) & ~F.coalesce(F.array_contains(held, i), F.lit(False))
    ends = F.transform(parts, lambda x, i: F.when(i == last, i).when(_may_end(x), F.when(let(token(x), lambda t: end(t, i)), i)))
    places = F.filter(ends, lambda i: i.isNotNull())
    whole = whole.withColumn(held, places)
    first = lambda j: F.coalesce(F.get(held, j - 1), F.lit(-1)) + 1
    made = F.transform(held, lambda e, j: F.regexp_replace(F.array_join(F.slice(parts, first(j) + 1, e - first(j) + 1), ""), r"^\s+|\s+$", ""))
    none = F.array().cast("array<string>")
    return whole.withColumn(out, F.coalesce(F.filter(made, lambda s: s != ""), none)).drop(key, held, parts)
