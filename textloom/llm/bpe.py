"""Byte-level BPE with the ranks of a public vocabulary: whole texts to ids and back.

Pieces of a pattern are encoded separately. Pieces of similar length stand in one padded matrix, a row
each; in every round each row merges its leftmost pair of minimum rank, pairs are looked up in an
open-addressing hash table, and rows and columns close up. Rows without a known pair are done. If a
token is part of no pair that ranks before it, which holds for nearly all, making it gives no pair of
lower rank: the next pairs to merge are then those of the same rank, so all of them, from the left, are
merged in one round, and a piece of any length needs about as many rounds as it meets different ranks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..ship import ship
from .common import spans, text_bytes

NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the joined token, in open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(left) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            _, first = np.unique(at[todo][free], return_index=True)
            placed = todo[free][first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], value[placed]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined ids, NONE for an unknown pair or if either id is negative."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (found != -1)
            todo, at = todo[go], (at[go] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)


class Bpe:
    """ranks: the lines of a rank file (base64 token, rank); pattern: what splits texts into pieces."""

    def __init__(self, ranks: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.tokens = {i: t for t, i in self.rank.items()}
        self.find = regex.compile(pattern)
        self.byte = np.array([self.rank.get(bytes([i]), -1) for i in range(256)], np.int32)
        cut = [(self.rank[t[:i]], self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        left, right, value = np.array(cut, np.int64).reshape(-1, 3).T
        self.pair = PairTable(left, right, value.astype(np.int32))
        least = np.full(max(self.tokens, default=0) + 1, NONE, np.int64)  # rank of the pairs a token is part of
        np.minimum.at(least, left, value)
        np.minimum.at(least, right, value)
        self.alone = least > np.arange(len(least))
        self.forget()

    def forget(self) -> None:
        """Start with no pieces known."""
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.rank:
                out[i] = np.array([self.rank[p]], np.int32)
            else:
                buckets.setdefault(_width(len(p)), []).append(i)
        for width, rows in buckets.items():
            most = max(1, (1 << 20) // width)
            for k in range(0, len(rows), most):
                part = rows[k : k + most]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Rounds of merges in every row that has a known pair."""
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte[data], np.int32(-1))
        ranks = np.full(ids.shape, NONE, np.int32)  # of a token and the one after it
        ranks[:, :-1] = self.pair(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(pieces))
        out: list = [None] * len(pieces)
        while True:
            best = ranks.min(axis=1)
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[row[k]] = ids[k, : lengths[k]].copy()
                live = ~done
                row, lengths, best, ids, ranks = row[live], lengths[live], best[live], ids[live], ranks[live]
            if not len(row):
                return out
            r, c = np.nonzero(ranks == best[:, None])
            if len(r) == len(row):  # one pair in each row: the columns close up by one
                ids, ranks = self._one_each(ids, ranks, c, best)
                lengths = lengths - 1
                continue
            r, c = np.nonzero(self._chosen(ranks == best[:, None], best))
            gone = np.bincount(r, minlength=len(row))
            column = np.arange(ids.shape[1])
            keep = column < lengths[:, None]
            keep[r, c + 1] = False
            ids[r, c] = best[r]
            lengths = lengths - gone
            column = column[: int(lengths.max())]
            there = column < lengths[:, None]
            ids, ranks = _closed(ids, keep, there, -1), _closed(ranks, keep, there, NONE)
            c = c - (np.arange(len(r)) - (np.cumsum(gone) - gone)[r])  # less those merged before in the row
            for side in (0, -1):
                p = c + side
                ok = p >= 0
                x, y = r[ok], p[ok]
                last = y + 1 >= lengths[x]
                after = ids[x, np.minimum(y + 1, len(column) - 1)]
                ranks[x, y] = self.pair(ids[x, y], np.where(last, np.int32(-1), after))

    def _one_each(self, ids: np.ndarray, ranks: np.ndarray, c: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pair at ``c`` of each row merged into ``best``."""
        here = np.arange(len(ids))
        ids[here, c] = best
        column = np.arange(ids.shape[1] - 1)
        take = column + (column > c[:, None])
        ids, ranks = np.take_along_axis(ids, take, axis=1), np.take_along_axis(ranks, take, axis=1)
        after = ids[here, np.minimum(c + 1, len(column) - 1)]
        ranks[here, c] = self.pair(best, np.where(c + 1 < len(column), after, np.int32(-1)))
        x = np.flatnonzero(c)
        ranks[x, c[x] - 1] = self.pair(ids[x, c[x] - 1], best[x])
        return ids, ranks

    def _chosen(self, hit: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of the pairs of minimum rank those to merge: the leftmost; if the token made can give no lower rank the others, too, of overlapping ones every other."""
        one = ~self.alone[best]
        if one.any():
            hit[one] &= np.cumsum(hit[one], axis=1) == 1
        if (hit[:, 1:] & hit[:, :-1]).any():
            column = np.arange(hit.shape[1])
            first = hit.copy()
            first[:, 1:] &= ~hit[:, :-1]
            start = np.maximum.accumulate(np.where(first, column, 0), axis=1)
            return hit & ((column - start) % 2 == 0)
        return hit

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not yet known and remember them."""
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        ids = self.encode_pieces([p.encode() for p in new])
        counts = np.array([len(x) for x in ids])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(counts) - counts)
        self.flat = np.concatenate([self.flat, *ids])
        self.counts = np.append(self.counts, counts)

    def ids(self, pieces: list[str]) -> np.ndarray:
        """The ids of known pieces, one after another."""
        code = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        counts = self.counts[code]
        first = np.cumsum(counts) - counts
        return self.flat[np.arange(int(counts.sum())) + np.repeat(self.starts[code] - first, counts)]

    def encode(self, text: str) -> np.ndarray:
        pieces = self.find.findall(text)
        self.learn(set(pieces))
        return self.ids(pieces)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _closed(x: np.ndarray, keep: np.ndarray, there: np.ndarray, empty: int) -> np.ndarray:
    """What is kept of each row, moved to its beginning."""
    out = np.full(there.shape, empty, np.int32)
    out[there] = x[keep]
    return out


def _width(n: int) -> int:
    """Buckets: lengths to 8 each, then steps of about a quarter."""
    step = 1 << max(0, (n - 1).bit_length() - 3)
    return -(-n // step) * step


_cache: dict[tuple[bytes, str], Bpe] = {}


def _tokenizer(ranks: bytes, pattern: str) -> Bpe:
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _cache:
        _cache[key] = Bpe(ranks, pattern)
    return _cache[key]


def _run(ranks, pattern: str, passed: list[str], ids: bool, remember: int, most: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(ranks.value, pattern)
        for batch in batches:
            _, offsets = text_bytes(batch["text"])
            for i, j in spans(offsets, most):
                texts = [t or "" for t in batch["text"].slice(i, j - i).to_pylist()]
                if len(bpe.known) > remember:
                    bpe.forget()
                found: list[tuple] = []
                if len(texts) > 1 or len(texts[0]) <= most:
                    pieces = [bpe.find.findall(t) for t in texts]
                    bpe.learn(set().union(*pieces))
                    parts = ([bpe.ids(p)] for p in pieces)
                else:  # one long text, block by block
                    parts = [_blocks(bpe, texts[0], remember, block)]
                for one in parts:
                    n, a, b, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                    for x in one:
                        n += len(x)
                        a.update(x.astype("<u4").tobytes())
                        b.update(bpe.decode(x))
                        if ids:
                            kept.append(x)
                    found.append((n, a.hexdigest(), b.hexdigest(), np.concatenate(kept) if kept else None))
                cols = {c: batch[c].slice(i, j - i) for c in passed}
                cols |= {"n_tokens": pa.array([f[0] for f in found], pa.int64()), "ids_sha256": pa.array([f[1] for f in found]), "decoded_sha256": pa.array([f[2] for f in found])}
                if ids:
                    cols["ids"] = pa.array([f[3] if f[3] is not None else [] for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)
        bpe.forget()  # the worker may live on, and others need the memory
        pa.default_memory_pool().release_unused()

    return run


def _blocks(bpe: Bpe, text: str, remember: int, block: int) -> Iterator[np.ndarray]:
    pieces = (m.group() for m in bpe.find.finditer(text))
    while part := list(islice(pieces, block)):
        if len(bpe.known) > remember:
            bpe.forget()
        bpe.learn(set(part))
        yield bpe.ids(part)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False, remember: int = 60_000, most: int = 1_000_000, block: int = 100_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 and, with ``ids``, ids: array<int>.

    ``docs`` has doc_id and text; other columns are not read. Null and empty texts have no tokens; every
    row gives one row, repeated or null doc_id or not. The rank file is read on the driver and sent to
    the executors (its size is that of the vocabulary); tokens that look like special ones are ordinary
    text. A worker remembers about ``remember`` pieces and works on ``most`` bytes of text at once; a longer
    text is worked on ``block`` pieces at a time (its ids, if asked for, are one array).
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(_run(ranks, pattern, ["doc_id"], ids, remember, most, block), schema)
