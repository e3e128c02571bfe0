"""Truncation, label masks, packing into fixed lengths, collation."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import let
from ..shared import unused
from .templates import EFFICIENT, Template, pairs

IGNORE = -100


def infer_lengths(source: Column, target: Column, cutoff: Column | int) -> Column:
    """struct<source, target>: how much of a prompt and a response to keep. A side of less than half leaves the rest to the other; else both shrink alike."""
    cutoff = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    most = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise(F.floor(cutoff * (target / (source + target))))
    new_target = F.least(most, target)
    return F.struct(F.least(F.greatest(cutoff - new_target, F.lit(0)), source).cast("int").alias("source"), new_target.cast("int").alias("target"))


def masked(prompt: Column, response: Column, train_on_prompt: bool = False) -> Column:
    """Labels of one turn: the prompt is ignored unless it is trained on."""
    head = prompt if train_on_prompt else F.transform(prompt, lambda _: F.lit(IGNORE))
    return F.concat(head, response)


def encode_turns(turns: Column, cutoff: int, mask_history: bool = False, train_on_prompt: bool = False, eos: int | None = None) -> Column:
    """struct<input_ids, labels> of array<struct<prompt, response>> (ids): turns share the cutoff in order, each by :func:`infer_lengths`.

    With ``mask_history`` only the last turn is learnt and turns are taken from the last to the first, so
    that the end is kept. ``eos`` closes the whole once (efficient end) and counts against the cutoff.
    """
    room = cutoff - (1 if eos is not None else 0)
    turns = F.reverse(turns) if mask_history else turns
    empty = F.array().cast("array<int>")
    start = F.struct(empty.alias("ids"), empty.alias("labels"), F.lit(0).alias("n"), F.lit(0).alias("k"))

    def add(a: Column, t: Column) -> Column:
        def cut(size: Column) -> Column:
            p, r = F.slice(t["prompt"], F.lit(1), size["source"]), F.slice(t["response"], F.lit(1), size["target"])
            ids = F.concat(p, r)
            silent = F.transform(r, lambda _: F.lit(IGNORE)) if mask_history else r
            labels = masked(p, F.when(a["k"] == 0, r).otherwise(silent), train_on_prompt)
            join = (lambda x, y: F.concat(y, x)) if mask_history else F.concat
            return F.struct(join(a["ids"], ids).alias("ids"), join(a["labels"], labels).alias("labels"), (a["n"] + F.size(ids)).alias("n"), (a["k"] + 1).alias("k"))

        full = a["n"] >= room
        return F.when(full, a).otherwise(let(infer_lengths(F.size(t["prompt"]), F.size(t["response"]), F.lit(room) - a["n"]), cut))

    last = F.array(F.lit(eos)) if eos is not None else empty
    return F.aggregate(turns, start, add, lambda a: F.struct(F.concat(a["ids"], last).alias("input_ids"), F.concat(a["labels"], last).alias("labels")))


def knapsack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``lengths`` in knapsacks: each takes the longest that still fits, again and again. Longer than the capacity: left out."""
    order = sorted((n, i) for i, n in enumerate(lengths) if n <= capacity)
    sizes, places = [n for n, _ in order], [i for _, i in order]
    sacks = []
    while sizes:
        sack, room = [], capacity
        while (k := bisect.bisect_right(sizes, room) - 1) >= 0:
            room -= sizes.pop(k)
            sack.append(places.pop(k))
        sacks.append(sack)
    return sacks


def pack_knapsack(rows: DataFrame, cutoff: int, batch: str = "batch", key: str = "key", ids: str = "input_ids", labels: str = "labels", pad: int = 0, neat: bool = True) -> DataFrame:
    """(batch, pack, keys, input_ids, labels, position_ids, attention_mask): sequences of a batch packed to ``cutoff`` + 1 ids.

    Each pack is padded; positions restart with each sequence; with ``neat`` the mask numbers the
    sequences (padding 0), else it is 1. Longer sequences are dropped. A batch is one task's group: its size
    is a parameter of :func:`~.preparation.batches`.
    """

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        out = []
        for n, sack in enumerate(knapsack([len(x) for x in g[ids]], cutoff)):
            some = g.iloc[sack]
            i, lab, pos, mask = [], [], [], []
            for k, (a, b) in enumerate(zip(some[ids], some[labels], strict=True)):
                i += list(a)
                lab += list(b)
                pos += range(len(a))
                mask += [k + 1 if neat else 1] * len(a)
            rest = cutoff + 1 - len(i)
            out.append((g[batch].iloc[0], n, list(some[key]), i + [pad] * rest, lab + [IGNORE] * rest, pos + [0] * rest, mask + [0 if neat else 1] * rest))
        return pd.DataFrame(out, columns=["batch", "pack", "keys", "input_ids", "labels", "position_ids", "attention_mask"])

    schema = "batch long, pack int, keys array<long>, input_ids array<int>, labels array<int>, position_ids array<int>, attention_mask array<int>"
    return rows.select(F.col(batch).cast("long").alias(batch), F.col(key).cast("long").alias(key), ids, labels).groupBy(batch).applyInPandas(pack, schema)


def pretrain_blocks(rows: DataFrame, block: int, order: str, batch: str = "batch", ids: str = "ids", eos: int | None = None, bos: int | None = None) -> DataFrame:
    """(batch, block, ids): the ids of a batch, each row closed by ``eos``, one after another in blocks; what does not fill one is dropped."""
    row_ids = F.concat(ids, F.array(F.lit(eos))) if eos is not None else F.col(ids)
    whole = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row_ids.alias("x")))).alias("rows"))
    whole = whole.select(batch, F.flatten(F.transform("rows", lambda r: r["x"])).alias("all"))
    n = F.floor(F.size("all") / block).cast("int")
    cut = whole.where(F.size("all") >= block).select(batch, "all", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    piece = F.slice("all", F.col("block") * block + 1, block)
    if bos is not None:
        piece = F.concat(F.array(F.lit(bos)), F.slice(piece, 2, block))
    return cut.select(batch, "block", piece.alias("ids"))


def position_ids(lengths: Column) -> Column:
    """Positions of packed sequences: each starts anew."""
    return F.flatten(F.transform(F.filter(lengths, lambda n: n > 0), lambda n: F.sequence(F.lit(0), n - 1)))


def segment_lengths(mask: Column) -> Column:
    """Lengths of the numbered sequences of a mask, padding (0) left out."""
    return F.transform(F.sort_array(F.array_distinct(F.filter(mask, lambda x: x > 0))), lambda s: F.size(F.filter(mask, lambda x: x == s)))


def cumulative(lengths: Column) -> Column:
    """0 and the running sums."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def block_mask(mask: Column) -> Column:
    """Who may attend to whom in a packed sequence: the same sequence, no padding, not later."""
    return F.transform(mask, lambda s, i: F.transform(mask, lambda t, j: (s == t) & (s != 0) & (j <= i)))


def pad_to(ids: Column, size: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(size - F.size(ids), F.lit(0))))


def pad_batch(rows: DataFrame, batch: str, columns: dict[str, int]) -> DataFrame:
    """Array columns padded to the longest of their batch with the value given for each."""
    for c, value in columns.items():
        longest = F.max(F.size(c)).over(Window.partitionBy(batch))
        rows = rows.withColumn("_longest", longest).withColumn(c, pad_to(F.col(c), F.col("_longest"), value)).drop("_longest")
    return rows


def pairwise_rows(rows: DataFrame, key: str) -> DataFrame:
    """Chosen rows, then rejected rows: (side, key, input_ids, labels)."""
    side = lambda i, name: rows.select(F.lit(i).alias("side"), key, F.col(f"{name}_input_ids").alias("input_ids"), F.col(f"{name}_labels").alias("labels"))
    return side(0, "chosen").unionByName(side(1, "rejected"))


def encode_pair(prompt: Column, chosen: Column, rejected: Column, cutoff: int) -> Column:
    """chosen_* and rejected_* ids and labels, both cut by the longer response."""

    def cut(size: Column) -> Column:
        p = F.slice(prompt, F.lit(1), size["source"])
        out = []
        for name, r in (("chosen", chosen), ("rejected", rejected)):
            kept = F.slice(r, F.lit(1), size["target"])
            out += [F.concat(p, kept).alias(f"{name}_input_ids"), masked(p, kept).alias(f"{name}_labels")]
        return F.struct(*out)

    return let(infer_lengths(F.size(prompt), F.greatest(F.size(chosen), F.size(rejected)), cutoff), cut)


def kto_pairs(rows: DataFrame, batch: str, order: str, response: str = "response") -> DataFrame:
    """Adds kl_response: the response of the row before in the batch; the first has the last's."""
    w = Window.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("kl_response", F.coalesce(F.lag(response).over(w), F.last(response).over(whole)))


def encode_kto(prompt: Column, response: Column, kl_response: Column, tag: Column, cutoff: int) -> Column:
    def one(r: Column, name: str) -> list[Column]:
        size = infer_lengths(F.size(prompt), F.size(r), cutoff)
        p, kept = F.slice(prompt, F.lit(1), size["source"]), F.slice(r, F.lit(1), size["target"])
        return [F.concat(p, kept).alias(f"{name}input_ids"), masked(p, kept).alias(f"{name}labels")]

    return F.struct(*one(response, ""), *one(kl_response, "kl_"), tag.alias("kto_tags"))


def encode_unsupervised(prompt: Column, response: Column, cutoff: int, eos: int | None = None) -> Column:
    """struct<input_ids, labels>: prompt ids and response ids apart, cut by :func:`infer_lengths`; ``eos`` ends the labels first (efficient end)."""
    labels = F.concat(response, F.array(F.lit(eos))) if eos is not None else response

    def cut(size: Column) -> Column:
        return F.struct(F.slice(prompt, F.lit(1), size["source"]).alias("input_ids"), F.slice(labels, F.lit(1), size["target"]).alias("labels"))

    return let(infer_lengths(F.size(prompt), F.size(labels), cutoff), cut)


def kto_batch(rows: DataFrame, batch: str, order: str, pad: int = 0) -> DataFrame:
    """(batch, order, input_ids, labels, kl_input_ids, kl_labels, kto_tags): both sides padded to the longest of their own in the batch."""
    return pad_batch(rows, batch, {"input_ids": pad, "labels": IGNORE, "kl_input_ids": pad, "kl_labels": IGNORE}).select(batch, order, "input_ids", "labels", "kl_input_ids", "kl_labels", "kto_tags")


def with_dummy_media(rows: DataFrame, batch: str, order: str, image_ids: list[int] | None = None, audio_ids: list[int] | None = None, left: bool = False) -> DataFrame:
    """Batches without media get the ids of a dummy: after the ids (before them if padding is on the ``left``) of the batch's first row, neither attended to nor learnt.

    ``image_ids``, for a model that takes images, are given to batches without images and videos, ``audio_ids`` to those without audio; the
    first row's ``_images`` and ``_audios`` name the dummy. Rows have input_ids, attention_mask, labels, _images, _videos, _audios; null media are none.
    Only a count and the first row's order of each batch are joined to the rows. ``order`` tells rows of a batch apart.
    """
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    seen, heard, first = unused(rows.columns, "seen", "heard", "first")
    counts = rows.groupBy(batch).agg(F.sum(n("_images") + n("_videos")).alias(seen), F.sum(n("_audios")).alias(heard), F.min(order).alias(first))
    rows_ = rows.join(counts, batch)
    mine = F.col(order).eqNullSafe(F.col(first))
    blind, deaf = mine & (F.col(seen) == 0) & F.lit(image_ids is not None), mine & (F.col(heard) == 0) & F.lit(audio_ids is not None)
    empty = F.array().cast("array<int>")
    some = lambda ids: F.array(*map(F.lit, ids)).cast("array<int>") if ids else empty
    dummy = F.concat(F.when(blind, some(image_ids)).otherwise(empty), F.when(deaf, some(audio_ids)).otherwise(empty))
    new = {"input_ids": dummy, "attention_mask": F.transform(dummy, lambda _: F.lit(0)), "labels": F.transform(dummy, lambda _: F.lit(IGNORE))}
    put = lambda c, x: F.concat(x, F.col(c)) if left else F.concat(F.col(c), x)
    named = {"_images": F.when(blind, F.array(F.lit("dummy"))).otherwise(F.col("_images")), "_audios": F.when(deaf, F.array(F.lit("dummy"))).otherwise(F.col("_audios"))}
    return rows_.select(*((put(c, new[c]) if c in new else named[c] if c in named else F.col(f"`{c}`")).alias(c) for c in rows.columns))


def tokenized(rows: DataFrame, pairs: str, encode: Callable[[str], list[int]], out: str = "turns") -> DataFrame:
    """Adds array<struct<prompt, response>> of ids for a column of the same of texts; ``encode`` is any tokenizer's, called batch by batch in Python workers."""
    kind = StructType([StructField("prompt", ArrayType(IntegerType())), StructField("response", ArrayType(IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [[{k: encode(p[k]) for k in ("prompt", "response")} for p in ps] for ps in b[pairs]]})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, ArrayType(kind))]))


def supervised(rows: DataFrame, t: Template, turns: str, encode: Callable[[str], list[int]], cutoff: int, eos: int | None = None, system: Column | None = None, **masks: bool) -> DataFrame:
    """Adds input_ids and labels: turns (role, content) rendered by a template, tokenized, cut and masked (:func:`encode_turns`); a template that closes a conversation once does so with ``eos``."""
    (pairs_, ids) = unused(rows.columns, "pairs", "ids")
    texts = tokenized(rows.withColumn(pairs_, pairs(t, F.col(turns), system)), pairs_, encode, ids)
    done = encode_turns(F.col(ids), cutoff, eos=eos if t.name in EFFICIENT else None, **masks)
    return texts.withColumn(ids, done).select(*(F.col(f"`{c}`") for c in rows.columns), F.col(ids)["input_ids"].alias("input_ids"), F.col(ids)["labels"].alias("labels"))


#: What encodes the rows of a stage; "sft" may pack.
PROCESSORS: dict[str, Callable] = {"pt": pretrain_blocks, "sft": encode_turns, "sft_packed": pack_knapsack, "rm": encode_pair, "kto": encode_kto, "ppo": encode_unsupervised}


def processor(stage: str, packing: bool = False, predict: bool = False) -> Callable:
    """By stage; generated predictions of any stage need prompts and labels apart."""
    if predict:
        return encode_unsupervised
    name = "sft_packed" if stage == "sft" and packing else stage
    if name not in PROCESSORS:
        raise ValueError(f"unknown stage {stage}")
    return PROCESSORS[name]


def token_rows(batches: Iterator[pd.DataFrame], encode) -> Iterator[pd.DataFrame]:
    """For mapInPandas: adds ids by any tokenizer's ``encode`` of text."""
    for b in batches:
        yield b.assign(ids=[encode(t) for t in b["text"]])
