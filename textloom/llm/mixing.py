"""Mixing sources to target weights over fixed-length blocks of words; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.preparation import indexed, running
from .common import WORD, row_digest, table

BLOCK, SHARD, CELLS, ROUNDS = 64, 65536, 1024, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sources(sized: DataFrame, weights: list[int], share: float, most: float, block: int) -> DataFrame:
    """sid, skey, source_size, source_from (words of the sources before), target, n_blocks, quota and quota_from of each source; one row each.

    Targets fill up like water: the level that all unlimited sources reach for each unit of weight is
    found from running sums over the sources in the order in which they meet their limits.
    """
    every = indexed(sized.groupBy("skey").agg(F.sum("size").alias("source_size")), ["skey"], "sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    every = every.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    every = table(every.withColumn("ratio", F.col("limit") / F.col("weight")), "limits")
    sums = every.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weighed = float(sums[0] or 0) * share, float(sums[1] or 0)
    every = running(every, ["ratio", "sid"], {"limit_before": "limit", "weight_before": "weight"})
    # the level if all sources before have their limit; after the first source whose limit is not met levels only fall
    level = (F.lit(total) - F.col("limit_before")) / (F.lit(weighed) - F.col("weight_before"))
    every = table(every.withColumn("level", level), "levels")
    free = every.where("level <= ratio").agg(F.max("level")).first()[0]
    every = every.withColumn("target", F.least("limit", F.lit(float("inf") if free is None else float(free)) * F.col("weight")))
    every = every.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block)))
    whole = F.least(F.round(F.coalesce(F.try_divide(F.col("target") * F.col("n_blocks"), F.col("source_size")), F.lit(0.0))), F.floor(F.col("n_blocks") * F.lit(float(most))))
    every = every.withColumn("quota", whole.cast("long")).select("sid", "skey", "source_size", "target", "n_blocks", "quota")
    return running(every, ["skey"], {"quota_from": "quota", "source_from": "source_size"})


def permuted(index: Column, n: Column, *keys: Column, rounds: int = ROUNDS) -> Column:
    """A keyed pseudorandom permutation of 0..n-1 (swap-or-not rounds): each round pairs x with k - x mod n and swaps by a keyed bit of the larger."""

    def turn(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, y), *keys, r), F.lit(2)) == 1, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, turn)


def _drawn(sources: DataFrame, seed: int, shard: int) -> DataFrame:
    """(sid, shard, first, count): which of its slots each source has in each output shard.

    Every slot of a shard draws its source with the quotas as probabilities, which makes the counts of a
    shard multinomial. A source stops when its quota is drawn; what then is missing from the others'
    quotas goes to one last shard, so the totals are the quotas.
    """
    spark = sources.sparkSession
    slots = int(sources.agg(F.sum("quota")).first()[0] or 0)
    cell = lambda x: F.floor(x * F.lit(CELLS) / F.lit(max(slots, 1)))
    spread = sources.where("quota > 0").select("sid", "quota_from", (F.col("quota_from") + F.col("quota")).alias("quota_to"))
    spread = spread.withColumn("cell", F.explode(F.sequence(cell(F.col("quota_from")), cell(F.col("quota_to") - 1))))
    drawn = spark.range(slots).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(slots, 1))).alias("u"))
    drawn = drawn.groupBy("shard", "u").agg(F.count("*").alias("k")).withColumn("cell", cell(F.col("u")))
    counts = drawn.join(spread, (drawn.cell == spread.cell) & (F.col("u") >= F.col("quota_from")) & (F.col("u") < F.col("quota_to")))
    counts = counts.groupBy("sid", "shard").agg(F.sum("k").alias("count"))
    quota = sources.where("quota > 0").select("sid", "quota")
    last = quota.select("sid", F.lit(slots // shard + 1).cast("long").alias("shard"), F.col("quota").alias("count"))
    run = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.unionByName(last).join(quota, "sid").withColumn("end", F.sum("count").over(run))
    start = F.least(F.col("end") - F.col("count"), F.col("quota"))
    return counts.select("sid", "shard", start.alias("first"), (F.least("end", "quota") - start).alias("count")).where("count > 0")


def _source_key() -> Column:
    """Sources by code point, null last."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), "source")).alias("skey")


def _tie() -> Column:
    return F.xxhash64("doc_id", "text").alias("tie")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 7, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: those of ``docs`` with size, source_size, target, sid, off (first word in the source) and ``row``, which names a row;
    pieces: sid, off, block, lo, hi (words of the row in the block), times (how often the block is taken).

    A source's texts, in pseudorandom order, are a row of words cut into blocks of ``block`` words. Sources by
    code point (null last) have ``weights`` in turn and share ``share`` times all words; a target stops at
    ``most`` times its source's size. Slots are drawn for each output shard (:func:`_drawn`); slot j of a
    source takes block p(j mod n) with p the permutation of round j div n; blocks are joined by index.
    Null or empty texts have size 0 and are never taken; repeated rows are rows of their own; same
    input, same result, however it is partitioned: rows that may change places in the order are equal rows. An empty table
    gives an empty result.
    """
    row = F.lit(None).cast("binary") if row is None else row
    salt = F.xxhash64(F.monotonically_increasing_id())  # deals equal rows to several ranges
    sized = table(docs.select("doc_id", _source_key(), n_words(F.col("text")).alias("size"), _tie(), row.alias("row"), salt.alias("salt")), "sizes")
    sources = table(_sources(sized, list(weights), share, most, block), "sources")
    rows = running(sized, ["skey", "tie", "row", "doc_id", "salt"], {"words_before": "size"}).join(sources.select("skey", "sid", "source_size", "source_from", "target"), "skey")
    rows = table(rows.select("doc_id", "row", "size", "source_size", "target", "sid", (F.col("words_before") - F.col("source_from")).alias("off")), "mixing-rows")

    slots = table(_drawn(sources, seed, shard), "draws").join(sources.select("sid", "n_blocks"), "sid")
    # few rows that each stand for many slots: dealt out before they are unfolded
    slots = slots.repartition(max(1, -(-int(sources.agg(F.sum("quota")).first()[0] or 0) // 50_000)), "sid", "shard").select("sid", "n_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("j"))
    n = F.col("n_blocks").cast("long")
    slots = slots.select("sid", permuted(F.pmod(F.col("j"), n), n, F.col("sid"), F.floor(F.col("j") / n), F.lit(seed)).alias("block"))
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    held = rows.where("size > 0").select("sid", "off", "size", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))).alias("block"))
    lo, hi = F.greatest(F.col("off"), F.col("block") * block) - F.col("off"), F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block) - F.col("off")
    pieces = held.join(times, ["sid", "block"]).select("sid", "off", "block", lo.alias("lo"), hi.alias("hi"), "times")
    return rows, pieces


def mix_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; see :func:`mixed`."""
    rows, pieces = mixed(docs, **options)
    taken = pieces.groupBy("sid", "off").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    taken = taken.select("sid", "off", F.lit(True).alias("real"), "taken")
    found = rows.withColumn("real", F.col("size") > 0).join(taken, ["sid", "off", "real"], "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents with the columns of ``docs``, whatever their names: each row that is taken, its text the words taken.

    A row whose blocks are all taken c times keeps its text as it is, c times, joined by a line end;
    others have their words joined by spaces, piece after piece in order, a piece taken twice twice.
    n_chars is set anew where there is such a column. Rows with null, empty or blank text are never taken; repeated rows are
    rows of their own, and equal ones interchangeable; an empty table stays empty.
    """
    rows, pieces = mixed(docs, row=row_digest(docs), **options)
    lists = pieces.groupBy("sid", "off").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("parts"))
    lists = rows.where("size > 0").join(lists, ["sid", "off"]).select("row", "size", "parts")
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns, strict=True)), row_digest(docs).alias("row"))
    text = names[docs.columns.index("text")]
    # equal rows are one before they are dealt; each of their lists takes it again
    kept = kept.where(F.col(text).rlike(WORD)).groupBy("row").agg(F.first(F.struct(*names)).alias("r"))
    both = lists.join(kept, "row").select("size", "parts", "r.*", F.col(f"r.{text}").alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    covered = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["hi"] - p["lo"])
    equal = (covered == F.col("size")) & (F.array_min(F.transform("parts", lambda p: p["times"])) == F.array_max(F.transform("parts", lambda p: p["times"])))
    whole = F.array_join(F.array_repeat("text", F.element_at("parts", 1)["times"].cast("int")), "\n")
    part = F.array_join(F.flatten(F.transform("parts", lambda p: F.flatten(F.array_repeat(F.slice("words", (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")), p["times"].cast("int"))))), " ")
    both = both.withColumn("words", F.when(~equal, words)).withColumn("text", F.when(equal, whole).otherwise(part))
    value = lambda i, f: F.col("text") if f.name == "text" else F.length("text").cast(f.dataType) if f.name == "n_chars" else F.col(f"c{i}")
    return both.select(*(value(i, f).alias(f.name) for i, f in enumerate(docs.schema.fields)))
