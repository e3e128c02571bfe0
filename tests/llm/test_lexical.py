"""Ranked lexical search against a plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm.lexical import Best, Shard, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, item_id string, score string, n int, item int"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    had = [(r[0], Counter(terms(r[1])), len(terms(r[1]))) for r in docs]
    had = [r for r in had if r[2]]
    N, L = len(had), sum(r[2] for r in had)
    df = Counter(t for _, c, _ in had for t in c)
    out = []
    for item_id, text in items:
        want = Counter(terms(text))
        scored = []
        for d, c, n in had:
            m = 75 + 25 * n * N // L
            s = sum(times * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in want.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def made(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["Élan", "ÉLAN", "naïve", "中文", "x1", "A", "b_c", "don't", "\x7fz"]
    texts = [rng.choice([" ", "\n", "-", "\xa0"]).join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[7] or "w1") for i in range(60)] + [(None, "w1 w2 w3"), (None, None), (3, "w1 w2 w3"), (3, "w1 w2 w3"), (5000, " ".join(["w3"] * 20000))]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20])))) for i in range(25)] + [(90, None), (91, ""), (92, "!!!"), (93, "absent"), (94, "w1"), (94, "w1"), (None, "w2 w2 w2 中文")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_postings": 50}, {"block_bytes": 40, "k": 3}])
def test_against_plain_scores(spark, options):
    docs, items = made(3)
    df = spark.createDataFrame([(*d, "clash", "clash", 1, 2) for d in docs], SCHEMA).repartition(4)
    queries = spark.createDataFrame([(*i, "clash", 4) for i in items], "item_id long, text string, doc_id string, rank int")
    got = Counter(map(tuple, ranked(df, queries, **options).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == brute(docs, items, options.get("k", 20))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked(docs.limit(0), items).count() == 0 and ranked(docs, items.limit(0)).count() == 0
    assert ranked(docs, items).count() == 1


def test_lists_are_not_read_to_their_ends():
    """A threshold below the 20th score stops the reading; documents that tie with the last are looked up first."""
    n = 20_000
    m = np.full(n, 100)
    tfs = np.where(np.arange(n) < 40, 50, 1)
    shard = Shard(np.arange(n), np.zeros(n, bool), np.arange(n + 1), np.zeros(n, np.int64), tfs, m, 1)
    best = Best()
    assert shard.search(np.array([0]), np.array([1000]), best, 20) < 500
    assert best.doc.tolist() == list(range(20))
    shard = Shard(np.arange(n), np.zeros(n, bool), np.arange(n + 1), np.zeros(n, np.int64), np.ones(n, np.int64), m, 1)
    best = Best()
    assert shard.search(np.array([0]), np.array([1000]), best, 20) == n  # all tie, so all must be seen
    assert best.doc.tolist() == list(range(20))
