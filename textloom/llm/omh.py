"""Order min-hash fingerprints of texts; DataFrame functions only.

The k-mers of a text are its runs of ``k`` words. A k-mer and its occurrence number (how often it has
come before in the text) make one element, so that repeats count. Each of ``FUNCTIONS`` independent
hash functions selects the two elements of least hash; they are put back in the order they have in the
text, and hashed as a tuple. Two texts agree in a function only if they share the least
elements *in the same order*, so the share of equal tuples falls with the edit distance, not only with
the change of the set.

Elements are unfolded to rows and aggregated where they are: the first pass finds the least hash of
every function, the second the least of what is above it. A hash's 33 high bits stand above 30 bits of
place, so minima of plain longs keep the place; no string that Spark can hold has 2**30 words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from ..operators.preparation import indexed
from .common import SPACE, runs, shifted, table, unused

K, FUNCTIONS = 5, 40
DIGITS = 8
_BITS = 30
_MASK = (1 << _BITS) - 1
_LOW = -(2**63)


def with_elements(df: DataFrame, text: str, k: int = K) -> DataFrame:
    """Adds el, array<long>: the elements of the text, and at, array<int>: the places of those beyond the first size(el) - size(at).

    The first ones are the k-mers by place (a k-mer that comes again is there again, which no minimum notices);
    then come the later occurrences, hashed with their number. With fewer than ``k`` words the whole
    sequence is the only k-mer; a null, empty or blank text has none.
    """
    w, mers, bits, ordered, near = unused(df.columns, "words", "mers", "bits", "ordered", "near")
    words = F.transform(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), ""), lambda x: F.xxhash64(x))
    out, run = runs(df.withColumn(w, words), w, k)
    none = F.array().cast("array<long>")
    out = out.withColumn(mers, F.when(F.size(w) >= k, F.col(run)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none))
    # only texts in which a k-mer comes again are sorted
    out = out.withColumn(bits, F.when(F.size(F.array_distinct(mers)) < F.size(mers), F.length(F.bin(F.size(mers)))))
    n = F.col(bits)
    pack = lambda h, i: shifted("shiftleft", shifted("shiftrightunsigned", h, n + 1), n).bitwiseOR(i.cast("long"))
    high = lambda v: shifted("shiftright", v, n)
    place = lambda v: v.bitwiseAND(shifted("shiftleft", F.lit(1).cast("long"), n) - 1).cast("int")
    out = out.withColumn(ordered, F.when(n.isNull(), none).otherwise(F.sort_array(F.transform(mers, pack))))
    alike = lambda v, i: (high(v) == high(F.get(ordered, i - 1))) | (high(v) == high(F.get(ordered, i + 1)))
    pairs = F.transform(F.filter(ordered, alike), lambda v: F.struct(F.get(mers, place(v)).alias("h"), place(v).alias("p")))
    out = out.withColumn(near, F.sort_array(pairs))

    def number(all_: Column, v: Column, i: Column) -> Column:
        """How many entries before place i have the same hash: by bisection, as equal ones are neighbours."""
        same = lambda d: F.get(all_, i - d)["h"] == v["h"]
        return F.aggregate(F.array(*(F.lit(1 << b) for b in range(_BITS - 1, -1, -1))), F.lit(0), lambda d, b: F.when((i - d - b >= 0) & same(d + b), d + b).otherwise(d))

    numbered = let(F.col(near), lambda a: F.transform(a, lambda v, i: F.struct(v["h"].alias("h"), v["p"].alias("p"), number(a, v, i).alias("n"))))
    later = F.filter(numbered, lambda v: v["n"] > 0)
    out = out.withColumn(near, F.when(F.size(near) > 0, F.transform(later, lambda v: F.struct(F.xxhash64(v["h"], v["n"]).alias("e"), v["p"].alias("p")))))
    more = F.col(near)
    el = F.when(more.isNull(), F.col(mers)).otherwise(F.concat(mers, F.transform(more, lambda v: v["e"])))
    at = F.when(more.isNull(), F.array().cast("array<int>")).otherwise(F.transform(more, lambda v: v["p"]))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), el.alias("el"), at.alias("at"))


def _values(df: DataFrame, keys: list[str], functions: int) -> DataFrame:
    """A row for each element of (el, at): keys, e, and its place."""
    n = F.size("el") - F.size("at")
    # without "outer" Spark adds a filter on the array, pushes it below and computes all of it once more
    rows = df.select(*keys, "at", n.alias("n"), F.posexplode_outer("el").alias("pos", "e")).where("pos IS NOT NULL")
    return rows.withColumn("place", F.when(F.col("pos") < F.col("n"), F.col("pos")).otherwise(F.get("at", F.col("pos") - F.col("n"))).cast("long"))


def _value(j: int) -> Column:
    """The element's hash by function j above its place."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64("e", F.lit(j)), 64 - (63 - _BITS)), _BITS).bitwiseOR(F.col("place"))


def fingerprints(texts: DataFrame, keys: list[str], kind: str, text: str, k: int = K, functions: int = FUNCTIONS) -> DataFrame:
    """(keys, kind, fingerprint): ``functions`` numbers of 32 bits, as binary, of each text that has a word.

    texts: keys, kind (an integer) and text, no two rows equal in keys and kind. Both passes aggregate and join by ``keys``: where
    ``texts`` is dealt by them, rows stay where they are. Texts with equal words have equal fingerprints.
    """
    rows = with_elements(texts.select(*keys, kind, text), text, k)
    first = _values(rows, [*keys, kind], functions).groupBy(*keys, kind).agg(*(F.min(_value(j)).alias(f"m{j}") for j in range(functions)))
    first = first.withColumnRenamed(kind, "_kind")
    both = texts.select(*keys, kind, text).join(first, keys).where(F.col(kind) - F.col("_kind") == 0).drop("_kind")  # kind is no join key
    names = [f"m{j}" for j in range(functions)]
    rows = _values(with_elements(both, text, k), [*keys, kind, *names], functions)
    above = lambda j: F.when(_value(j) > F.col(f"m{j}").bitwiseOR(F.lit(_MASK)), _value(j))
    found = rows.groupBy(*keys, kind).agg(*(F.min(f"m{j}").alias(f"m{j}") for j in range(functions)), *(F.min(above(j)).alias(f"s{j}") for j in range(functions)))

    def tuple_(j: int) -> Column:
        a, b = F.col(f"m{j}"), F.col(f"s{j}")
        x, y = F.shiftright(a, _BITS), F.shiftright(b, _BITS)
        turned = a.bitwiseAND(F.lit(_MASK)) > b.bitwiseAND(F.lit(_MASK))
        hashed = F.when(b.isNull(), F.xxhash64(x)).when(turned, F.xxhash64(y, x)).otherwise(F.xxhash64(x, y))
        return F.unhex(F.lpad(F.hex(F.shiftrightunsigned(hashed, 32)), DIGITS, "0"))

    return found.select(*keys, kind, F.concat(*map(tuple_, range(functions))).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples of two fingerprints in hexadecimal digits."""
    n = F.length(a) / DIGITS
    part = lambda x, i: F.substring(x, i * DIGITS + 1, F.lit(DIGITS))
    same = F.filter(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: part(a, i) == part(b, i))
    return F.size(same) / n


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, fp, text): id is doc_id, or the least long for null; fp hashes the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("id"), F.xxhash64("text", F.col("text").isNull()).alias("fp"), F.coalesce("text", F.lit("")).alias("text"))


def next_rows(docs: DataFrame) -> DataFrame:
    """(id, fp, k, n, nid, nfp): of each class of k rows equal in id and text, n code points long, the next class by descending doc_id
    (then hash of the text, null ids last); after the last the first.

    Classes are numbered (:func:`~textloom.operators.preparation.indexed`) and joined by number, without their texts.
    """
    classes = _keyed(docs).groupBy("id", "fp").agg(F.count("*").alias("k"), F.max(F.length("text")).alias("n"))
    rows = table(indexed(classes, [F.desc("id"), F.asc("fp")], "at"), "order")
    after = rows.select(F.pmod(F.col("at") - 1, F.greatest(F.lit(rows.count()), F.lit(1))).alias("at"), F.col("id").alias("nid"), F.col("fp").alias("nfp"))
    return rows.join(after, "at").drop("at")


def edited(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(id, fp, kind, text): of each class its text (kind 0), its text with the last floor(n / 2) code points replaced by the first as many (or
    all) of the next class's text (1) and, if it has several rows, of its own text (2).

    Only the beginnings that are needed travel: each class learns how much the class before it takes. One of equal rows is taken before they are dealt.
    """
    w = F.row_number().over(Window.partitionBy("id", "fp").orderBy(F.lit(0)))
    whole = _keyed(docs).withColumn("nth", w).where("nth = 1").drop("nth")
    asked = links.select(F.col("nid").alias("id"), F.col("nfp").alias("fp"), F.col("id").alias("pid"), F.col("fp").alias("pfp"), F.col("k").alias("pk"), F.expr("cast(n div 2 as int)").alias("need"))
    heads = whole.join(asked, ["id", "fp"]).select(F.col("pid").alias("id"), F.col("pfp").alias("fp"), F.col("pk").alias("k"), F.expr("left(text, need)").alias("head"))
    begun = "left(text, length(text) - cast(length(text) div 2 as int))"
    kinds = ["struct(0 AS kind, text AS text)", f"struct(1 AS kind, concat({begun}, head) AS text)", f"CASE WHEN k > 1 THEN struct(2 AS kind, concat({begun}, left(text, cast(length(text) div 2 as int))) AS text) END"]
    both = whole.join(heads, ["id", "fp"]).select("id", "fp", F.explode(F.expr(f"array({', '.join(kinds)})")).alias("v"))
    return both.where("v IS NOT NULL").select("id", "fp", F.col("v.kind").alias("kind"), F.col("v.text").alias("text"))


def compare_edits(docs: DataFrame, k: int = K, functions: int = FUNCTIONS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs`` (doc_id, text).

    fingerprint: ``functions`` numbers of DIGITS hexadecimal digits; of a text without words all zeros. Null text is
    empty; texts may be of any length. Rows may repeat or lack a doc_id: each row is one, in the order of :func:`next_rows`; of equal rows each but the last has
    an equal one next. A single row is its own next. An empty table gives an empty result.
    """
    links = table(next_rows(docs), "next")
    texts = edited(docs, links)
    sha = texts.select("id", "fp", "kind", F.when(F.col("kind") > 0, F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("sha"))
    prints = fingerprints(texts, ["id", "fp"], "kind", "text", k, functions).withColumnRenamed("kind", "_kind")
    paired = sha.join(prints, (sha.id == prints.id) & (sha.fp == prints.fp) & (sha.kind - prints._kind == 0), "left").select(sha.id, sha.fp, sha.kind, "sha", "fingerprint")
    rows = table(paired, "fingerprints")
    of = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = rows.groupBy("id", "fp").agg(of("fingerprint", 0).alias("f"), *(of(c, i).alias(f"{c[0]}{i}") for i in (1, 2) for c in ("fingerprint", "sha")))
    other = rows.where("kind = 0").select(F.col("id").alias("nid"), F.col("fp").alias("nfp"), F.col("fingerprint").alias("next"))
    found = wide.join(links, ["id", "fp"]).join(other, ["nid", "nfp"])
    text = lambda c: F.coalesce(F.lower(F.hex(c)), F.lit("0" * (DIGITS * functions)))
    last = found.select("id", "n", F.lit(1).cast("long").alias("times"), F.lower(F.hex("s1")).alias("edited_sha256"), text("f").alias("fingerprint"), text("f1").alias("edited_fingerprint"), text("next").alias("next"))
    inner = found.where("k > 1").select("id", "n", (F.col("k") - 1).alias("times"), F.lower(F.hex("s2")).alias("edited_sha256"), text("f").alias("fingerprint"), text("f2").alias("edited_fingerprint"), text("f").alias("next"))
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    out = reduce(DataFrame.unionByName, [last, inner.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(1000).cast("long")))).withColumn("times", F.least(F.lit(1000).cast("long"), F.col("times") - F.col("part"))).drop("part")])
    out = out.select(F.when(F.col("id") != _LOW, F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next").alias("near_next"), "times")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "col")
