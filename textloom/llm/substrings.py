"""Exact removal of long repeated substrings with distributed difference-cover suffix sorting.

The bytes of all texts form one collection of strings. A byte goes if a string of ``LENGTH`` bytes
that covers it also starts anywhere else. Every start i of such a string is a suffix whose first
LENGTH bytes count, so the work is to sort suffixes and to compare neighbours:

1. Distribution. Each start is dealt to the anchor of its string: the leftmost minimum hash of the
   CORE-byte substrings inside the string. Equal strings have equal anchors, so only starts whose
   anchors are equal need to be sorted together. Consecutive starts with one anchor make a
   *context*: the bytes from the first start to the end of the last string. Contexts whose anchor
   occurs once cannot repeat and leave here; equal contexts are counted once (pre-aggregation).
2. Sorting. The contexts of a bucket of anchors are sorted by the difference-cover algorithm
   (:func:`suffix_array`): sort the triples of the sample i mod 3 != 0, recurse on their names,
   merge the remaining suffixes, compare adjacent prefixes.
3. An anchor with more than ``max_group`` different contexts is divided by a longer common core
   first (STEP starts share LENGTH - STEP + 1 bytes), and at last by the string itself, so that no
   task holds an unbounded group. Nothing is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..ship import ship
from .common import drop_table, keyed_hashes, mix, place_key, ranges, secret, spans, table, text_bytes

LENGTH, CORE, STEP = 200, 48, 16
_B1 = np.uint64(0x2545F4914F6CDD1D)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[int(base)] = have = (out[0], out[1])
    return have


class Hasher:
    """Hashes of any substring of ``data`` in constant time, by differences of polynomial prefix sums.

    They deal work out and make features; that strings are equal is never concluded from them.
    """

    def __init__(self, data: np.ndarray, base: np.uint64):
        self.up, self.down = _power(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def __call__(self, starts, ends) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` keys, by block prefix and suffix minima."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, core: int, key: bytes = b"") -> tuple[np.ndarray, ...]:
    """row, first start, last start, anchor (relative to the row), anchor hash, context hash; starts partition each row's.

    Contexts are hashed by a cryptographic function under ``key``: equal hashes stand for equal contexts.
    """
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= length)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    whole = Hasher(data, _B1)
    at = np.arange(len(data) - core + 1)
    hashes = whole(at, at + core)
    low = sliding_min((hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - core + 1)
    counts = size[rows] - length + 1
    starts = ranges(offsets[rows], counts)
    anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    first, a = starts[new], anchor[new]
    last = starts[np.append(new[1:], len(starts)) - 1]
    row = np.repeat(rows, counts)[new]
    body = data.tobytes()
    inner = keyed_hashes((body[b:z] for b, z in zip(first.tolist(), (last + length).tolist(), strict=True)), key)
    shape = ((last - first) << 32 | (first - a) & 0xFFFFFFFF).astype(np.uint64)
    origin = offsets[row]
    return row, first - origin, last - origin, a - origin, hashes[a], mix(inner + mix(shape))


def pieces(offsets: np.ndarray, length: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row numbers, offsets, shift) of bounded runs of rows; a long row comes in parts overlapping by length - 1."""
    for i, j in spans(offsets, most):
        if offsets[j] - offsets[i] <= 2 * most:
            yield np.arange(i, j), offsets[i : j + 1], 0
        else:
            for shift in range(0, int(offsets[i + 1] - offsets[i]), most):
                end = min(offsets[i] + shift + most + length - 1, offsets[i + 1])
                yield np.array([i]), np.array([offsets[i] + shift, end]), shift


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of the non-negative integers ``s`` by the difference cover {1, 2} modulo 3.

    All steps are whole-array: the sampled triples are sorted and named; equal names are resolved by
    recursion on the string of names; the other suffixes are sorted by first symbol and the rank of
    their sampled tail; the merge counts, for every unsampled suffix, the smaller sampled ones of
    either residue with a binary search over keys of (symbols, rank).
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    t[:n] += 1
    most = int(t.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a dummy keeps the halves apart
    sample = np.concatenate([one, two])
    if most < 1 << 20:
        key = (t[sample] * most + t[sample + 1]) * most + t[sample + 2]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        new = np.zeros(len(sample), bool)
        new[0] = True
        for k in range(3):
            x = t[sample + k][order]
            new[1:] |= x[1:] != x[:-1]
    name = np.cumsum(new)
    if name[-1] < len(sample):
        names = np.empty(len(sample), np.int64)
        names[order] = name
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    by_rank = sample[order]
    by_rank = by_rank[by_rank < n]
    zero = np.arange(0, n, 3)
    step = len(sample) + 2
    zero_key = t[zero] * step + rank[zero + 1]
    ordered = np.argsort(zero_key, kind="stable")
    zero, zero_key = zero[ordered], zero_key[ordered]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    below_one = np.searchsorted(t[ones] * step + rank[ones + 1], zero_key)
    # (symbol, symbol, rank) as two levels: the pair of symbols is named densely, so that keys stay in 64 bits
    pair_two, pair_zero = t[twos] * most + t[twos + 1], t[zero] * most + t[zero + 1]
    if most * most < (1 << 62) // step:
        below_two = np.searchsorted(pair_two * step + rank[twos + 2], pair_zero * step + rank[zero + 2])
    else:
        known = np.unique(pair_two)
        place = np.searchsorted(known, pair_zero)
        hit = place < len(known)
        hit[hit] = known[place[hit]] == pair_zero[hit]
        key = np.searchsorted(known, pair_two) * step + rank[twos + 2]
        below_two = np.searchsorted(key, place * step + np.where(hit, rank[zero + 2], 0))
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + below_one + below_two
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = by_rank
    return out


def repeated(texts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, start) of every start whose first ``length`` bytes start anywhere else too; counts: starts of each text."""
    sizes = np.array([len(x) for x in texts])
    s = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    origin = np.cumsum(sizes + 1) - sizes - 1
    symbols = s.astype(np.int64) + 1
    symbols[origin + sizes] = 0
    valid = np.zeros(len(s), bool)
    valid[ranges(origin, counts)] = True
    order = suffix_array(symbols)
    order = order[valid[order]]
    again = np.zeros(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(s, length) if len(s) >= length else None
    for i in range(0, len(order) - 1, 1 << 14):
        a, b = order[i : i + (1 << 14)], order[i + 1 : i + 1 + (1 << 14)]
        same = (view[a[: len(b)]] == view[b]).all(axis=1)
        again[i : i + len(b)] |= same
        again[i + 1 : i + 1 + len(b)] |= same
    found = order[again]
    found.sort()
    text = np.searchsorted(origin, found, "right") - 1
    return text, found - origin[text]


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of the intervals [first, last), sorted; touching intervals join."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.r_[True, first[1:] > last[:-1]])
    return first[new], last[np.append(new[1:], len(first)) - 1]


_CONTEXT = "did long, fp long, s int, e int, a int, ah long, ch long"


def _find(length: int, core: int, secret_key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            did, fp = batch["did"].to_numpy(), batch["fp"].to_numpy()
            for rows, offs, shift in pieces(offsets, length):
                row, s, e, a, ah, ch = contexts(data, offs, length, core, secret_key)
                if len(row):
                    row = rows[row]
                    cols = [did[row], fp[row], *((x + shift).astype(np.int32) for x in (s, e, a)), ah.view(np.int64), ch.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["did", "fp", "s", "e", "a", "ah", "ch"])

    return run


_CUT = "ah long, did long, fp long, s int, e int, a int, ctx binary"


def _cut(length: int):
    """A document and its list of contexts -> the contexts' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            did, fp, marks = batch["did"].to_numpy(), batch["fp"].to_numpy(), batch["marks"]
            ends = marks.offsets.to_numpy()
            s, e, a, ah = (marks.values.field(k).to_numpy() for k in ("s", "e", "a", "ah"))
            held: list[list] = [[] for _ in range(7)]
            size = 0
            for i in range(len(batch)):
                whole = data[offsets[i] : offsets[i + 1]]
                for j in range(ends[i], ends[i + 1]):
                    ctx = whole[s[j] : e[j] + length].tobytes()
                    for h, x in zip(held, (ah[j], did[i], fp[i], s[j], e[j], a[j], ctx), strict=True):
                        h.append(x)
                    size += len(ctx)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays(_arrays(held), ["ah", "did", "fp", "s", "e", "a", "ctx"])
                    held, size = [[] for _ in range(7)], 0
            yield pa.RecordBatch.from_arrays(_arrays(held), ["ah", "did", "fp", "s", "e", "a", "ctx"])

    return run


def _arrays(held: list[list]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return [pa.array(h, k) for h, k in zip(held, kinds, strict=True)]


def _sort_groups(length: int, most: int = 1 << 20):
    """Rows sorted by ah and place: whole groups are gathered to about ``most`` bytes, each place once, suffix-sorted, and their repeated starts returned."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[4] for r in rows]
        text, start = repeated(texts, np.array([len(x) - length + 1 for x in texts]), length)
        new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(start, prepend=-9) != 1)) if len(text) else np.zeros(0, np.int64)
        end = start[np.append(new[1:], len(text)) - 1] if len(new) else new
        base = np.array([r[3] for r in rows], np.int64)
        which = text[new]
        cols = [np.array([r[1] for r in rows], np.int64)[which], np.array([r[2] for r in rows], np.int64)[which], (base[which] + start[new]).astype(np.int32), (base[which] + end + length).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["did", "fp", "b", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last, place = 0, None, None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("ah", "did", "fp", "s", "ctx")), strict=True):
                if row[0] != last and size >= most:
                    yield solve(rows)
                    rows, size = [], 0
                if row[:4] == place:  # a row equal in id and text
                    continue
                last, place = row[0], row[:4]
                rows.append(row)
                size += len(row[4])
        if rows:
            yield solve(rows)

    return run


def _divide(length: int, step: int, secret_key: bytes):
    """Contexts -> parts of at most ``step`` starts on a grid relative to the anchor, keyed by the core all strings of a grid cell share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digest(x: bytes) -> int:
            return int.from_bytes(hashlib.blake2b(x, digest_size=8, key=secret_key).digest(), "little", signed=True)

        for batch in batches:
            held: list[list] = [[] for _ in range(8)]
            size = 0
            for ah, did, fp, s, e, a, ctx in zip(*(batch[c].to_pylist() for c in ("ah", "did", "fp", "s", "e", "a", "ctx")), strict=True):
                for cell in range((s - a) // step, (e - a) // step + 1):
                    b, z = max(s, a + cell * step), min(e, a + cell * step + step - 1)
                    part = ctx[b - s : z - s + length]
                    lo = a + cell * step + step - 1 - b
                    key = digest(part[lo : lo + length - step + 1] + f"|{ah}|{cell}".encode())
                    same = digest(part + f"|{b - a}|{z - a}".encode())
                    for h, x in zip(held, (key, did, fp, b, z, a, part, same), strict=True):
                        h.append(x)
                    size += len(part)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([*_arrays(held[:7]), pa.array(held[7], pa.int64())], ["ah", "did", "fp", "s", "e", "a", "ctx", "ch"])
                    held, size = [[] for _ in range(8)], 0
            yield pa.RecordBatch.from_arrays([*_arrays(held[:7]), pa.array(held[7], pa.int64())], ["ah", "did", "fp", "s", "e", "a", "ctx", "ch"])

    return run


def _counted(df: DataFrame, name: str) -> DataFrame:
    """(ah, ch, n, low, groups, all): rows equal in ah and ch, the least of them, different ch of an ah and all its rows.

    Partial sums precede each shuffle; the join is between two tables, so that Spark can split a hot anchor's rows.
    """
    same = table(df.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("did", "fp", "s")).alias("low")), f"{name}-same")
    groups = table(same.groupBy("ah").agg(F.count("*").alias("groups"), F.sum("n").alias("all")), f"{name}-groups")
    known = table(same.join(groups, "ah"), name)
    drop_table(same)
    drop_table(groups)
    return known


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, max_group: int = 4000) -> DataFrame:
    """(did, fp, b, z): byte intervals [b, z) of ``docs`` (did, fp, text) that repeated strings of ``length`` bytes cover.

    Intervals of a document may overlap. did, fp: see :func:`~.common.place_key`. Texts below ``length``
    bytes, empty and null texts have none; rows equal in id and text count as two places.
    """
    key = secret()
    found = table(docs.select("did", "fp", "text").mapInArrow(_find(length, core, key), _CONTEXT), "anchors")
    often = table(found.groupBy("ah").agg(F.count("*").alias("n")).where("n > 1").select("ah"), "often")
    kept = table(found.join(often, "ah"), "repeated-anchors")  # between two tables: a hot anchor's rows can be split
    drop_table(found)
    known = _counted(kept, "classes")
    rows = kept.join(known, ["ah", "ch"])
    row_is = F.struct("did", "fp", "s") == F.col("low")
    out = [rows.where("n > 1").select("did", "fp", F.col("s").alias("b"), (F.col("e") + length).alias("z"))]
    marks = rows.where((F.col("groups") > 1) & ((F.col("n") == 1) | row_is)).dropDuplicates(["did", "fp", "s"])
    marks = marks.groupBy("did", "fp").agg(F.collect_list(F.struct("s", "e", "a", "ah")).alias("marks"))
    texts = docs.select("did", "fp", "text").join(marks, ["did", "fp"])
    cut = table(texts.select("did", "fp", "text", "marks").mapInArrow(_cut(length), _CUT), "contexts")
    crowd = known.where(F.col("groups") > max_group).select("ah").distinct()
    out.append(_sorted(cut.join(crowd, "ah", "left_anti"), length))
    for step in (STEP, 1):
        parts = table(cut.join(crowd, "ah", "left_semi").mapInArrow(_divide(length, step, key), _CUT + ", ch long"), f"parts{step}")
        known = _counted(parts, f"part-classes{step}")
        rows = parts.join(known, ["ah", "ch"])
        out.append(rows.where("n > 1").select("did", "fp", F.col("s").alias("b"), (F.col("e") + length).alias("z")))
        rest = rows.where((F.col("groups") > 1) & ((F.col("n") == 1) | row_is))
        crowd = known.where(F.col("groups") > max_group).select("ah").distinct()
        cut = rest.select("ah", "did", "fp", "s", "e", "a", "ctx")
        if step > 1:
            out.append(_sorted(cut.join(crowd, "ah", "left_anti"), length))
    spans_ = out[0]
    for x in out[1:]:
        spans_ = spans_.unionByName(x)
    return spans_


def _sorted(cut: DataFrame, length: int) -> DataFrame:
    dealt = cut.repartition("ah").sortWithinPartitions("ah", "did", "fp", "s")
    return dealt.select("ah", "did", "fp", "s", "ctx").mapInArrow(_sort_groups(length), "did long, fp long, b int, z int")


def _apply(extra: list[str], texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            spans_ = batch["spans"]
            ends = spans_.offsets.to_numpy()
            b, z = (spans_.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("b", "z"))
            empty = spans_.is_null().to_numpy(zero_copy_only=False)
            removed, runs, digest, kept = [], [], [], []
            for i in range(len(batch)):
                whole = data[offsets[i] : offsets[i + 1]]
                lo, hi = ends[i], ends[i + 1]
                if empty[i] or lo == hi:
                    left, gone, n = whole.tobytes(), 0, 0
                else:
                    first, last = merged(b[lo:hi], z[lo:hi])
                    edges = np.r_[0, np.column_stack([first, last]).ravel(), len(whole)]
                    if texts:  # a character goes if all its bytes do
                        edges = _whole_characters(whole, edges)
                    left = b"".join(whole[edges[k] : edges[k + 1]].tobytes() for k in range(0, len(edges), 2))
                    gone, n = int((last - first).sum()), len(first)
                removed.append(gone)
                runs.append(n)
                digest.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left.decode())
            cols = {k: batch[k] for k in extra}
            cols |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if texts:
                cols["kept_text"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _apply_schema(texts: bool) -> list[StructField]:
    fields = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return fields + [StructField(c, StringType()) for c in ("kept_sha256", "kept_text")[: 1 + texts]]


def _whole_characters(whole: np.ndarray, edges: np.ndarray) -> np.ndarray:
    tail = lambda i: i < len(whole) and (whole[i] & 0xC0) == 0x80
    out = edges.copy()
    for k in range(1, len(out) - 1, 2):
        while tail(out[k]) and out[k] < out[k + 1]:
            out[k] += 1
        while tail(out[k + 1]) and out[k + 1] > out[k]:
            out[k + 1] -= 1
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, max_group: int = 4000, texts: bool = False) -> DataFrame:
    """Remove every byte of ``text`` covered by a string of ``length`` bytes that also starts anywhere else.

    docs: doc_id, text and any other columns, of which only these two are read. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 and, with ``texts``, kept_text: the text that
    stays (a character of which only some bytes go stays). Null text is empty; repeated rows are
    different places, so both lose their repeats; an empty table gives an empty result; doc_id may be
    null or repeat, and every input row gives one row.
    """
    ship(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *place_key())
    spans_ = repeated_spans(keyed, length, core, max_group)
    lists = spans_.groupBy("did", "fp").agg(F.collect_set(F.struct("b", "z")).alias("spans"))
    joined = keyed.join(lists, ["did", "fp"], "left").select("doc_id", "text", "spans")
    schema = StructType([StructField("doc_id", LongType()), *_apply_schema(texts)])
    return joined.mapInArrow(_apply(["doc_id"], texts), schema)


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeats removed from text (see :func:`remove_repeats`), all columns; n_chars is set anew where there is one.

    A character stays unless all its bytes go. A text of which nothing is left is empty.
    """
    ship(docs.sparkSession)
    did, fp = place_key()
    at = docs.columns.index("text")
    held = [f"_c{i}" for i in range(len(docs.columns)) if i != at]  # names of docs may be any
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns) if i != at), F.coalesce("text", F.lit("")).alias("text"), did, fp)
    lists = repeated_spans(keyed.select("did", "fp", "text"), **options).groupBy("did", "fp").agg(F.collect_set(F.struct("b", "z")).alias("spans"))
    rows = keyed.join(lists, ["did", "fp"], "left").select(*held, "text", "spans")
    kinds = [StructField(f"_c{i}", f.dataType) for i, f in enumerate(docs.schema.fields) if i != at]
    out = rows.mapInArrow(_apply(held, True), StructType(kinds + _apply_schema(True)))
    length = F.length("kept_text")
    return out.select(*((F.col("kept_text") if i == at else length.cast(f.dataType) if f.name == "n_chars" else F.col(f"_c{i}")).alias(f.name) for i, f in enumerate(docs.schema.fields)))
