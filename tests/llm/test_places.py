"""Texts of any length: places take as many bits as they need, and hashes that agree in the rest are compared whole."""

import random
import re
from collections import Counter


def test_repeated_windows_of_long_texts(spark):
    from textloom.llm.quality import statistics

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (7, 8, 9, 500, 20_000)] + [" ".join(str(i) for i in range(70_000)) + " 5 6 7 8 9 10 11 12 13"]

    def plain(t, k=8):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        hit = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                hit.update(range(i, i + k))
        return len(hit)

    for k in (8, 5):
        got = statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), window=k).collect()
        assert {r.i: r.n_repeat_words for r in got} == {i: plain(t, k) for i, t in enumerate(texts)}
