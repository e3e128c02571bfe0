"""Packing of token sequences by linear grouping and best fit.

1. Pieces: documents are tokenized where they lie; a row for each piece of at most ``capacity`` tokens.
2. Order: pieces are numbered from the longest down. The numbers of pieces of each length (at most ``capacity`` counts,
   however many pieces) are all that the driver plans with.
3. Linear grouping: large pieces are cut by rank into groups of equal cardinality and count as long as the longest of
   their group. Configurations (how many pieces of each group share a sequence) are chosen by column generation for the
   linear program over these few sizes, rounded down, and what is left is filled first-fit. A configuration used t times
   takes runs of ranks of its groups, so a piece's sequence follows from its rank: actual documents take the places of
   rounded ones without a shuffle.
4. Best fit: sequences are numbered by the room that actual lengths leave. Small pieces, longest first, go where the
   least room that suffices is; all sequences with equal room and all pieces of equal length are dealt with at once, and
   a piece's sequence again follows from its rank.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.preparation import indexed
from ..ship import ship
from .common import ranges, spans, table, text_bytes

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_tokenizers: dict = {}


def _tokenizer(path: str, special_as_text: bool):
    if (path, special_as_text) not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = special_as_text
        _tokenizers[path, special_as_text] = made
    return _tokenizers[path, special_as_text]


def _words(x: np.ndarray, offs: np.ndarray, fine: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The runs of bytes other than ASCII white space of each row, one row after another, and their number in each row.

    ``fine``: A-Z is lower-cased unless a character beyond ASCII, which might combine with it, follows, and runs are cut
    between an ASCII letter and ASCII punctuation and, but for apostrophes, between punctuation and a letter.
    """
    gap = (x == 32) | ((x >= 9) & (x <= 13))
    new = np.ones(len(x) + 1, bool)
    new[1:] = np.append(gap, True)[: len(x)]
    new[offs] = True
    if fine:
        upper = (x >= 65) & (x <= 90)
        letter = upper | ((x >= 97) & (x <= 122))
        other = (x > 32) & (x < 127) & ~letter & ~((x >= 48) & (x <= 57))
        new[1:-1] |= (letter[:-1] & other[1:]) | (other[:-1] & (x[:-1] != 39) & letter[1:])
        x = np.where(upper & (np.append(x[1:], np.uint8(0)) < 128), x + np.uint8(32), x)
    starts = np.flatnonzero(~gap & new[:-1])
    counts = np.diff(np.searchsorted(starts, offs))
    before = np.cumsum(~gap) - ~gap
    kept = np.ascontiguousarray(x[~gap])
    ends = np.append(before[starts], len(kept)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(kept)]), counts


def _encoded(words: list[str], tokenizer, mark: tuple[str, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words and their number in each; with a special token as mark, a thousand words at a time between marks."""
    if mark is None:
        found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([t for e in found for t in e], "<u4"), np.array([len(e) for e in found], np.int64)
    joined = [mark[0].join(words[i : i + 1000]) + mark[0] for i in range(0, len(words), 1000)]
    ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False))])
    ends = np.flatnonzero(ids == mark[1])
    return ids[ids != mark[1]], np.diff(ends, prepend=-1) - 1


class Encoder:
    """Ids of texts by a tokenizer that lower-cases, drops white space and breaks words between letters and other characters.

    No token or normal form reaches across such a break, so each different word is encoded once for every ``most`` words;
    texts that hold a special token's string are only broken at white space, and their words encoded one by one.
    """

    def __init__(self, tokenizer, most: int = 400_000):
        self.tokenizer, self.most = tokenizer, most
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = [] if tokenizer.encode_special_tokens else [t.lower().encode() for t in special]
        self.mark = min(special.items(), key=lambda t: t[1]) if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.sizes, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _learn(self, words: pa.Array, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the place and the number of its ids in an array, and the array."""
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        if not fine:
            ids, sizes = _encoded(coded.dictionary.to_pylist(), self.tokenizer, None)
            return (np.cumsum(sizes) - sizes)[at], sizes[at], ids
        place = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(place.is_null())
        if len(self.known) and len(self.known) + len(new) > self.most:
            self._forget()
            return self._learn(words, fine)
        ids, sizes = _encoded(new.to_pylist(), self.tokenizer, self.mark)
        where = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        where[where < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.sizes, self.ids = np.append(self.sizes, sizes), np.append(self.ids, ids)
        return (np.cumsum(self.sizes) - self.sizes)[where[at]], self.sizes[where[at]], self.ids

    def __call__(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, numbers of ids) of runs of rows."""
        for i, j in spans(offsets, most):
            base = int(offsets[i])
            x = data[base : int(offsets[j])]
            low = x.tobytes().lower() if self.special else b""
            fine = not any(t in low for t in self.special)
            words, counts = _words(x, offsets[i : j + 1] - base, fine)
            first, sizes, every = self._learn(words, fine)
            ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]]
            yield every[ranges(first, sizes)], np.diff(ends)


def _pieces(path: str, capacity: int, end: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(_tokenizer(path, special_as_text))
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            row = 0
            for ids, counts in encode(data, offsets):
                at, out = 0, []
                for i, n in enumerate(counts.tolist()):
                    whole = np.append(ids[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        part = whole[start : start + capacity]
                        out.append((row + i, k, start, len(part), zlib.crc32(part.tobytes())))
                row += len(counts)
                r, *rest = zip(*out, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(r)), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def configurations(sizes: list[int], counts: list[int], capacity: int, most_rounds: int = 5000) -> list[tuple[list[int], int]]:
    """[(pieces of each size, times)] that hold ``counts`` pieces of ``sizes`` in few sequences of ``capacity``.

    The linear program over all configurations is solved by column generation (the dual prices' best configuration enters, by an
    exact knapsack), its solution is rounded down, and the few pieces left are filled first-fit, longest first.
    """
    k = len(sizes)
    size, need = np.array(sizes), np.array(counts, float)
    base, cost = np.diag(capacity // size).astype(float), np.ones(k)
    for _ in range(most_rounds):
        prices = np.linalg.solve(base.T, cost)
        low = int(np.argmin(prices))
        if prices[low] < -1e-9:  # more pieces of this size than there are
            enter, price = np.zeros(k), 0.0
            enter[low] = -1
        else:
            enter, price = _knapsack(size, prices, capacity), 1.0
            if prices @ enter <= 1 + 1e-9:
                break
        x, step = np.linalg.solve(base, need), np.linalg.solve(base, enter)
        up = step > 1e-9
        ratio = np.full(k, np.inf)
        ratio[up] = np.maximum(x[up], 0) / step[up]
        leave = int(np.argmin(ratio))
        base[:, leave], cost[leave] = enter, price
    times = np.floor(np.maximum(np.linalg.solve(base, need), 0) + 1e-9).astype(int)
    out = [([int(a) for a in base[:, p]], int(times[p])) for p in range(k) if cost[p] and times[p]]
    left = [max(0, c - sum(a[g] * t for a, t in out)) for g, c in enumerate(counts)]
    while any(left):
        room, some = capacity, [0] * k
        for g in sorted(range(k), key=lambda g: -sizes[g]):
            some[g] = min(left[g], room // sizes[g])
            room -= some[g] * sizes[g]
        times_ = min(left[g] // some[g] for g in range(k) if some[g])
        left = [c - a * times_ for c, a in zip(left, some, strict=True)]
        out.append((some, times_))
    return out


def _knapsack(size: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the highest price, any number of each size."""
    value, last = np.zeros(capacity + 1), []
    while True:  # with one more piece in each round
        more, which = value.copy(), np.full(capacity + 1, -1)
        for g in np.flatnonzero(prices > 1e-12):
            s = size[g]
            one = value[: capacity + 1 - s] + prices[g]
            better = one > more[s:] + 1e-12
            more[s:][better] = one[better]
            which[s:][better] = g
        if (which < 0).all():
            break
        value = more
        last.append(which)
    out, room = np.zeros(len(size)), capacity
    for which in reversed(last):
        g = which[room]
        if g >= 0:
            out[g] += 1
            room -= size[g]
    return out


Flows = list[tuple[int, int, int]]


def group_flows(lengths: list[tuple[int, int]], capacity: int, groups: int, rank: int, number: int) -> tuple[Flows, int, int]:
    """Ranks of large pieces -> sequences: [(first rank, first sequence, pieces in each)], the rank and the sequence after them.

    ``lengths``: (length, count), longest first; ``rank``, ``number``: of the first piece and the first sequence.
    """
    n = sum(c for _, c in lengths)
    each = -(-n // groups)
    ends = np.cumsum([c for _, c in lengths])
    firsts = list(range(0, n, each))
    size = [lengths[int(np.searchsorted(ends, f, "right"))][0] for f in firsts]
    count = [min(each, n - f) for f in firsts]
    flows: Flows = []
    used = [0] * len(firsts)
    for pattern, times in configurations(size, count, capacity):
        for g, a in enumerate(pattern):
            if a and used[g] < count[g]:
                flows.append((rank + firsts[g] + used[g], number, a))
                used[g] += a * times
        number += times
    return sorted(flows), rank + n, number


def best_fit_flows(lengths: list[tuple[int, int]], room: list[tuple[int, int]], capacity: int, rank: int, number: int) -> tuple[Flows, int]:
    """Best fit of small pieces, longest first: [(first rank, first sequence, pieces in each)] and the number of sequences.

    ``room``: (room, count) of the sequences there are, numbered from ``number`` in this order; new ones follow.
    """
    held: dict[int, list[tuple[int, int]]] = {}
    for r, c in room:
        if r:
            held.setdefault(r, []).append((number, c))
        number += c
    rooms = sorted(held)

    def put(r: int, run: tuple[int, int]) -> None:
        if r and run[1]:
            if r not in held:
                bisect.insort(rooms, r)
                held[r] = []
            held[r].append(run)

    flows: Flows = []
    for s, c in lengths:
        while c:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                new = -(-c // (capacity // s))
                put(capacity, (number, new))
                number += new
                continue
            r = rooms[at]
            first, many = held[r].pop()
            if not held[r]:
                del held[r]
                rooms.pop(at)
            q = r // s
            full = min(many, c // q)
            if full:
                flows.append((rank, first, q))
                rank, c = rank + full * q, c - full * q
                put(r - q * s, (first, full))
            if full < many:
                if c and c < q:
                    flows.append((rank, first + full, c))
                    put(r - c * s, (first + full, 1))
                    rank, c, full = rank + c, 0, full + 1
                put(r, (first + full, many - full))
    return flows, number


def _placed(flows: Flows, out: str):
    """Adds the sequence of each rank."""
    table_ = np.array(flows, np.int64).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            f = np.searchsorted(table_[:, 0], rank, "right") - 1
            yield batch.append_column(out, pa.array(table_[f, 1] + (rank - table_[f, 0]) // table_[f, 2]) if len(rank) else pa.array([], pa.int64()))

    return run


def packed(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, small: int = 3, groups: int = 128, special_as_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the pieces of all ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    A document is its text's ids, then ``end``; null and empty texts are the end alone. Longer ones are cut into pieces of
    ``capacity``, the last may be shorter. Pieces of more than 1/``small`` of the capacity are large and go into ``groups``
    groups. Repeated rows are documents of their own; doc_id may be null or repeat; other columns are not read; an empty
    table gives an empty result. ``special_as_text``: strings of special tokens in a text are ordinary text.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, capacity, end, special_as_text), _PIECE)
    cut = table(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    order: list[str | Column] = [F.desc("length"), "doc_id", "piece", "ids_crc32", "salt"]  # the salt spreads equal rows
    ranked = indexed(cut, order, "rank").drop("salt")
    lengths = [(r.length, r["count"]) for r in cut.groupBy("length").count().orderBy(F.desc("length")).collect()]  # one row for each length
    whole = sum(c for n, c in lengths if n == capacity)
    large = [(n, c) for n, c in lengths if capacity // small < n < capacity]
    flows, rank, number = group_flows(large, capacity, groups, whole, 0) if large else ([], whole, 0)
    fields = f"{_PIECE}, rank long, sequence long"
    big = table(ranked.where((F.col("length") < capacity) & (F.col("length") > capacity // small)).mapInArrow(_placed(flows, "sequence"), fields), "large-pieces")
    rooms = big.groupBy("sequence").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    rooms = table(indexed(rooms, ["room", "sequence"], "number").select("sequence", "room", "number"), "rooms")
    room = [(r.room, r["count"]) for r in rooms.groupBy("room").count().orderBy("room").collect()]  # one row for each room
    flows, _ = best_fit_flows([(n, c) for n, c in lengths if n <= capacity // small], room, capacity, rank, 0)
    little = ranked.where(F.col("length") <= capacity // small).mapInArrow(_placed(flows, "number"), f"{_PIECE}, rank long, number long")
    shared = big.join(rooms.select("sequence", "number"), "sequence").drop("sequence").unionByName(little)
    before = Window.partitionBy("number").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + whole).alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    alone = ranked.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(shared)
