"""Packing: ids against the tokenizer, sequences against their promises and against plain best fit."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm.bestfit import Encoder, _tokenizer, best_fit_flows, configurations, group_flows, packed
from textloom.llm.common import text_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = ["a", "B", "Z", "W", "I", "s", "t", "'", "'s", "'LL", ".", "-", "…", "ñ", "É", "̊", "́", "̇", " ", "\n", "\xa0", "　", "0", "7", "²", "中", "🙂", "<", "|", ">", "_", "Σ", "ﬁ", "‍", "\x00", "\x7f", "\x1c"]


def test_ids_are_the_tokenizers():
    rng = random.Random(5)
    for special in ([], ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]):
        for as_text in (False, True):
            tokenizer = _tokenizer(PATH, as_text)
            texts = ["".join(rng.choice(LETTERS + special) for _ in range(rng.randint(0, 40))) for _ in range(2500)] + ["", None, "x" * 10_000]
            data, offsets = text_bytes(pa.array(texts))
            got = [x.tolist() for ids, n in Encoder(tokenizer, most=500)(data, offsets, 3000) for x in np.split(ids, np.cumsum(n)[:-1])]
            assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def plain_best_fit(lengths, capacity):
    rooms, n = [], 0
    for s in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, s)
        room = rooms.pop(at) if at < len(rooms) else capacity
        n += room == capacity
        if room > s:
            bisect.insort(rooms, room - s)
    return n


def test_best_fit_of_equal_pieces_at_once_is_best_fit():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
        counts = [(n, lengths.count(n)) for n in sorted(set(lengths), reverse=True)]
        flows, n = best_fit_flows(counts, [], capacity, 0, 0)
        load, order = defaultdict(int), sorted(lengths, reverse=True)
        for (first, number, q), last in zip(flows, [f[0] for f in flows[1:]] + [len(order)]):
            for r in range(first, last):
                load[number + (r - first) // q] += order[r]
        assert max(load.values()) <= capacity and sum(load.values()) == sum(lengths)
        assert len(load) == n == plain_best_fit(lengths, capacity)


def test_configurations_hold_everything():
    rng = random.Random(7)
    for _ in range(60):
        sizes = sorted({rng.randint(35, 100) for _ in range(rng.randint(1, 12))}, reverse=True)
        counts = [rng.randint(0, 200) for _ in sizes]
        found = configurations(sizes, counts, 100)
        assert all(sum(a * s for a, s in zip(c, sizes)) <= 100 and t > 0 for c, t in found)
        assert all(sum(c[g] * t for c, t in found) >= n for g, n in enumerate(counts))
        bound = max(-(-sum(s * c for s, c in zip(sizes, counts)) // 100), sum(c for s, c in zip(sizes, counts) if s > 50))
        assert sum(t for _, t in found) <= 1.35 * bound + len(sizes)


def test_groups_keep_to_the_capacity():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1400, 4095) for _ in range(3000)), reverse=True)
    counts = [(n, lengths.count(n)) for n in sorted(set(lengths), reverse=True)]
    flows, rank, n = group_flows(counts, 4096, 64, 10, 0)
    assert rank == 3010
    load = np.zeros(n, int)
    for (first, number, q), last in zip(flows, [f[0] for f in flows[1:]] + [rank]):
        r = np.arange(first, last)
        np.add.at(load, number + (r - first) // q, np.array(lengths)[r - 10])
    assert load.max() <= 4096 and load.sum() == sum(lengths)


@pytest.mark.parametrize("capacity,groups", [(64, 8), (4096, 128), (3, 2)])
def test_packing(spark, capacity, groups):
    rng = random.Random(capacity)
    words = ["data", "Über", "naïve", "don't", "x1", "…", "token"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 20, 150]))) for _ in range(300)] + ["far " * 9000, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "same text")] * 400 + [(4, "other")]
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "doc_id long, text string, rank int, length string, number int").repartition(4)
    got = packed(df, PATH, capacity, groups=groups).collect()
    tokenizer = _tokenizer(PATH, False)
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s : s + capacity], "<u4")
            want.append((d, k, s, len(part), zlib.crc32(part.tobytes())))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(g)[:5] for g in got), key=order) == sorted(want, key=order)
    by = defaultdict(list)
    for g in got:
        by[g.sequence_id].append((g.offset, g.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    assert len(by) <= 1.05 * plain_best_fit([w[3] for w in want], capacity) + 2
    assert packed(df.limit(0), PATH, capacity).count() == 0
