"""Mixing against a plain computation of sizes and targets, and the mixture's promises."""

import re
from collections import Counter, defaultdict

import pytest

from textloom.llm.mixing import _drawn, _sources, mix_documents, mix_words, permuted

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, skey string"


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        now = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if now[s] > most * sizes[s] + 1e-9]
        if not over:
            return now | fixed
        fixed |= {s: most * sizes[s] for s in over}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(n, seed):
    import random

    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "src10", "src9", ""]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 50, 200, 700])
        text = rng.choice([" ", "\n"]).join(f"w{rng.randrange(99)}" for _ in range(size))
        rows.append((i, text, rng.choices(sources, [60, 5, 5, 2, 2, 2, 1])[0], "en", len(text), "clash"))
    return rows + [(None, "no id at all", "a", None, 1, None), (None, None, "a", None, None, None), (3, "twice", "b", "en", 5, "x"), (3, "twice", "b", "en", 5, "x"), (9999, None, "only empty", "en", 0, "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_targets(spark, seed):
    rows = rows_of(400, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_words(df).collect()
    assert len(got) == len(rows)
    sizes, by = Counter(), defaultdict(list)
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
        by[r[0]].append(r)
    want = targets(sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken = Counter()
    for g in got:
        mine = [r for r in by[g.doc_id] if len(words(r[1])) == g.size]
        assert mine and any(abs(g.target - want[r[2]]) < 1e-6 and g.source_size == sizes[r[2]] for r in mine)
        assert 0 <= g.taken <= 2 * g.size
        taken[mine[0][2]] += g.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(0.02 * want[s], 64), (s, n, want[s])
    again = mix_words(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_sf(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mix_words(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = targets(sizes)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken = Counter()
    for g in got:
        taken[source[g.doc_id]] += g.taken
        assert g.target == pytest.approx(want[source[g.doc_id]])
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 64 for s in want)


def test_empty(spark):
    assert mix_words(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100, 1001):
        seen = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit(0))).collect()]
        assert sorted(seen) == list(range(n))
    assert seen != sorted(seen)


def test_draws_keep_quotas(spark):
    sized = spark.createDataFrame([("a" + k, n) for k, n in [("x", 50_000), ("y", 9_000), ("z", 100)]], "skey string, size long")
    sources = _sources(sized, [5, 2, 1], 1.5, 2.0, 8)
    quota = {r.sid: r.quota for r in sources.collect()}
    drawn = _drawn(sources, 3, 512).collect()
    sums = Counter()
    for r in sorted(drawn, key=lambda r: r.shard):
        assert r["first"] == sums[r.sid]
        sums[r.sid] += r["count"]
    assert sums == quota
    assert len({r.shard for r in drawn}) > 5


def test_documents_are_the_words_taken(spark):
    rows = rows_of(150, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    taken = Counter()
    for r in mix_words(df).collect():
        taken[r.doc_id] += r.taken
    mixed = mix_documents(df)
    assert mixed.columns == df.columns
    got = Counter()
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]] |= set(words(r[1]))
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        assert set(words(r.text)) <= texts[r.doc_id] and r.n_chars == len(r.text)
    assert +got == +taken


def test_columns_of_any_name(spark):
    from textloom.llm.jaccard import one_of_each
    from textloom.llm.mixing import mix_documents

    names = ["skey", "tie", "nth", "parts", "_size", "size", "_words", "words", "_id", "_row_did", "_row_nth", "_kept_did", "did", "fp", "blank", "c0", "c1", "sid", "a.b"]
    rows = [(i, f"one text of words number {i} and {i * i} more of them", f"s{i % 2}", *(f"{n}-{i}" for n in names)) for i in range(20)]
    rows += [rows[3], (None, None, None, *names), (50, rows[4][1], "s0", *(f"{n}-50" for n in names))]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    want = {r[0]: r[2:] for r in rows}
    for f in (one_of_each, mix_documents):
        got = f(df)
        assert got.columns == df.columns
        found = got.collect()
        assert found and all(tuple(r)[2:] == want[r.doc_id] for r in found)
    assert sorted((r.doc_id for r in one_of_each(df).collect()), key=str) == sorted([*range(20), None], key=str)
