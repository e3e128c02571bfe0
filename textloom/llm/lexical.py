"""Ranked lexical search with Fagin's threshold algorithm over impact-sorted posting lists.

1. Forward index: one row for each document with the items' terms it holds and how often (a table; texts are read once).
   Its sums give N, L and each term's document frequency, so the weights are those of the whole corpus.
2. Search: a task turns the documents it reads into shards of bounded size. A shard has, for each term, its list of
   (document, impact) from the highest impact down, and the forward index by document. For an item the lists are read
   round-robin, a run of places at a time; each document met is looked up in the forward index for its whole score; the
   threshold is what a document at the present places of all lists would score. Reading stops when the threshold falls
   strictly below the 20th best score so far, or when the lists are used up. The best documents go on from shard to
   shard, so later shards stop sooner.
3. The best of all tasks are merged, first within salted parts of an item, then for each item.

Nothing is shuffled but at most k rows for each item and task. Items are taken in blocks of bounded size, against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.preparation import running
from ..ship import ship
from .common import ranges, spans, table, text_bytes

_FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "item int, doc_id long, score long, part int"


def term_array(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of each row, one row after another, and each row's number of terms.

    A term is a maximal run of ASCII letters, digits and bytes of other characters, A-Z lower-cased.
    """
    base = int(offsets[0])
    x = data[base : int(offsets[-1])]
    offs = offsets - base
    kind = np.zeros(256, bool)
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    inside = kind[x]
    new = np.ones(len(x) + 1, bool)  # the byte before is outside or another row's
    new[1:] = np.append(~inside, True)[: len(x)]
    new[offs] = True
    starts = np.flatnonzero(inside & new[:-1])
    counts = np.diff(np.searchsorted(starts, offs))
    low = np.where((x >= 65) & (x <= 90), x + np.uint8(32), x)[inside]  # terms side by side
    before = np.cumsum(inside) - inside
    ends = np.append(before[starts], len(low)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low))]), counts


def _forward(vocabulary: list[bytes]):
    """Documents -> their numbers of terms and, of the vocabulary, the terms they hold with frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            for i, j in spans(offsets, 1 << 22):
                terms, counts = term_array(data, offsets[i : j + 1])
                ids = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(j - i), counts)[ids >= 0]
                keys, tfs = np.unique(row * len(vocabulary) + ids[ids >= 0], return_counts=True)
                ends = np.searchsorted(keys, np.arange(j - i + 1) * len(vocabulary)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % max(len(vocabulary), 1), tfs)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(counts.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


class Shard:
    """Documents with a forward index and, for each term, their list from the highest impact down."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, size: int):
        self.doc, self.null, self.ends, self.terms = doc, null, ends, terms
        tf = tfs.astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(ends)))
        order = np.lexsort((-self.impact, terms))
        self.list_doc = np.repeat(np.arange(len(doc)), np.diff(ends))[order]
        self.list_impact = self.impact[order]
        self.list_ends = np.searchsorted(terms[order], np.arange(size + 1))
        self.weight = np.zeros(size, np.int64)
        self.seen = np.zeros(len(doc), bool)

    def lookup(self, rows: np.ndarray) -> np.ndarray:
        """Whole scores by the forward index; every row holds a term."""
        n = self.ends[rows + 1] - self.ends[rows]
        at = ranges(self.ends[rows], n)
        return np.add.reduceat(self.weight[self.terms[at]] * self.impact[at], np.cumsum(n) - n)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, k: int) -> int:
        """Reads the lists until no document unseen can be among the best; returns the number of documents looked up."""
        self.weight[terms] = weights
        first, last = self.list_ends[terms], self.list_ends[terms + 1]
        depth, step, met = 0, 2 * k, []
        while True:
            lo, hi = np.minimum(first + depth, last), np.minimum(first + depth + step, last)
            at = np.unique(self.list_doc[ranges(lo, hi - lo)])
            new = at[~self.seen[at]]
            if len(new):
                self.seen[new] = True
                met.append(new)
                best.add(self.lookup(new), self.doc[new], self.null[new], k)
            depth, step = depth + step, depth + step
            left = hi < last
            threshold = int((weights[left] * self.list_impact[hi[left] - 1]).sum())  # impacts below are no higher
            if not left.any() or len(best.score) >= k and threshold < best.score[-1]:
                break
        self.weight[terms] = 0
        for new in met:
            self.seen[new] = False
        return sum(map(len, met))


class Best:
    """The k best (score, document) so far, highest first, equal scores by id, null ids last."""

    def __init__(self):
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> None:
        if len(self.score) >= k:
            keep = score >= self.score[-1]
            score, doc, null = score[keep], doc[keep], null[keep]
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:k]
        order = order[score[order] > 0]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def _search(items: list[tuple[np.ndarray, np.ndarray]], size: int, N: int, L: int, k: int, most: int):
    """Forward index rows -> the best documents for each item, at most k for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in items]
        part = 0
        held: list[pa.RecordBatch] = []
        n = 0

        def solve() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            doc = t["doc_id"].combine_chunks()
            lists = [t[c].combine_chunks() for c in ("terms", "tfs")]
            terms, tfs = (x.flatten().to_numpy() for x in lists)
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists[0]).to_numpy())].astype(np.int64)
            m = 75 + 25 * t["n"].to_numpy() * N // L
            shard = Shard(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), ends, terms, tfs, m, size)
            for (ids, weights), b in zip(items, best, strict=True):
                shard.search(ids, weights, b, k)

        for batch in batches:
            for i in range(0, len(batch), 1024):
                some = batch.slice(i, 1024)
                held.append(some.filter(pc.greater(pc.list_value_length(some["terms"]), 0)))
                n += int(pc.sum(pc.list_value_length(held[-1]["terms"])).as_py() or 0)
                part = part or hash((held[0]["doc_id"][0].as_py() if len(held[0]) else 0, len(batch))) & 63
                if n >= most:
                    solve()
                    held, n = [], 0
        if n:
            solve()
        if sum(len(b.score) for b in best):
            cols = [np.repeat(np.arange(len(items)), [len(b.score) for b in best]).astype(np.int32), *(np.concatenate([getattr(b, c) for b in best]) for c in ("doc", "score"))]
            null = np.concatenate([b.null for b in best])
            arrays = [pa.array(cols[0]), pa.array(cols[1], mask=null), pa.array(cols[2]), pa.array(np.full(len(null), part, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "doc_id", "score", "part"])

    return run


def _top(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 4 << 20, shard_postings: int = 2_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents with a score above 0 for each row of ``items`` (item_id, text).

    ``docs``: doc_id, text; other columns are not read. Null and empty texts hold no term: such documents are in no
    result and not counted, such items have no rows. Repeated rows of documents are documents of their own and may both
    be found (equal scores by id, null ids last); repeated items have rows each. Empty tables give an empty result.
    ``block_bytes``: items are collected and searched in blocks of about so many bytes; ``shard_postings``: postings of
    a task's shard. Results depend on neither.
    """
    spark = docs.sparkSession
    ship(spark)
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.octet_length("text").cast("long"))
    if (sized.agg(F.sum("size")).first()[0] or 0) <= block_bytes:
        blocks = [sized]
    else:
        dealt = table(running(sized, ["item_id", "text"], {"before": "size"}).withColumn("block", F.floor(F.col("before") / block_bytes)), "items")
        blocks = [dealt.where(F.col("block") == b[0]) for b in dealt.select("block").distinct().orderBy("block").toLocalIterator()]
    out = None
    for block in blocks:
        found = _block(docs, block.select("item_id", "text").collect(), k, shard_postings)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _block(docs: DataFrame, items: list, k: int, shard_postings: int) -> DataFrame:
    spark = docs.sparkSession
    texts = pa.array([r.text for r in items], pa.string())
    terms, counts = term_array(*text_bytes(texts)) if len(items) else (pa.array([], pa.large_binary()), np.zeros(0, np.int64))
    coded = terms.dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    cut = np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum(counts)[:-1]) if len(items) else []
    forward = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_forward(vocabulary), _FORWARD)
    forward = table(forward.where("n > 0"), "forward")
    N, L = forward.agg(F.count("*"), F.sum("n")).first()
    df = dict(forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row for each term of the block
    wanted = []
    for ids in cut:
        each, times = np.unique(ids, return_counts=True)
        w = np.array([math.floor(1000 * math.log((2 * N + 2) / (2 * df.get(int(t), 0) + 1))) for t in each], np.int64) * times
        wanted.append((each[w > 0], w[w > 0]))
    found = forward.mapInArrow(_search(wanted, len(vocabulary), N, L or 1, k, shard_postings), _FOUND)
    best = _top(_top(found, k, "item", "part").drop("rank"), k, "item")
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
