"""Texts built so that structured hashes collide, and rows that are equal in part: the same results as by plain comparison, in all partitionings."""

import random
from collections import Counter

import pytest


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_with_equal_polynomial_hashes(spark, n):
    import numpy as np

    from textloom.llm.jaccard import jaccard_classes, one_of_each
    from textloom.llm.shingles import _BASE
    from textloom.llm.substrings import Hasher

    a, b = thue_morse(n), thue_morse(n, "ba")
    hashes = [int(Hasher(np.frombuffer(x.encode(), np.uint8), _BASE)(np.array([0]), np.array([n]))[0]) for x in (a, b)]
    assert hashes[0] == hashes[1]  # whatever the base
    df = spark.createDataFrame([(1, a), (2, b), (3, f"x y z {a} v w"), (4, f"x y z {b} v w"), (5, a)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_classes(df).collect())) == [(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 1, 1)]
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("crowd", [4000, 1])
def test_contexts_built_to_collide(spark, crowd):
    from textloom.llm.substrings import remove_repeats

    rng = random.Random(1)
    core = "".join(rng.choice("cdefgh") for _ in range(60))
    texts = [thue_morse(m, s) + core + thue_morse(m, t) for m in (128, 256, 1024) for s in ("ab", "ba") for t in ("ab", "ba")] * 2
    texts += [thue_morse(1024), thue_morse(1024, "ba"), thue_morse(512) + thue_morse(512, "ba")]

    from test_edges import brute_repeats

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, remove_repeats(df, max_group=crowd).collect()))
    assert got == [(i, *w) for i, w in enumerate(brute_repeats(texts))]


def test_rows_of_one_id_with_equal_hashes(spark):
    """Two texts with equal xxhash64 under one id are two places: what repeats of one stays in the other."""
    from pyspark.sql import functions as F
    from test_edges import brute_repeats

    from textloom.llm.jaccard import one_of_each
    from textloom.llm.substrings import remove_repeats

    rng = random.Random(5)
    a = "vkxkqockqqqqqqqqqqqqqqqqqqqqqqqqfagsnmnaqqqqqqqqqqqqqqqqqqqqqqqq"
    b = "erqesapiqqqqqqqqqqqqqqqqqqqqqqqqGPh'/!z)qqqqqqqqqqqqqqqqqqqqqqqq"
    tail = "".join(rng.choice("cdefgh ") for _ in range(400))
    texts = [a + tail, b + tail, "other " + a + tail[:150]]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[0][:190]), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.where("doc_id = 1").select(F.xxhash64("text")).distinct().count() == 1
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute_repeats([t for _, t in rows]), strict=True)), key=order)
    assert sorted(map(tuple, remove_repeats(df).collect()), key=order) == want
    short = spark.createDataFrame([(1, a), (1, b)], "doc_id long, text string")
    assert sorted(r.text for r in one_of_each(short).collect()) == sorted([a, b])


def test_rows_that_differ_elsewhere_in_all_partitionings(spark):
    """400 rows equal in id, text and source, and 100 equal in everything: the same rows, whole, whatever the partitions."""
    from textloom.llm.jaccard import one_of_each
    from textloom.llm.mixing import mix_documents

    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(90))
    rows = [(7, text, "s", i, {"k": str(i)}, [i]) for i in range(400)] + [(7, text, "s", -1, {"k": "x"}, None)] * 100
    rows += [(i, " ".join(f"v{rng.randrange(999)}" for _ in range(80)), rng.choice(["s", "t", None]), 0, None, None) for i in range(60)] + [(None, " ", "s", 5, None, None), (None, None, "s", 6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, r map<string,string>, size array<int>")
    mixed, ones = [], []
    for n in (1, 3, 7):
        some = df.repartition(n)
        mixed.append(Counter(str(r) for r in mix_documents(some).collect()))
        ones.append(Counter(str(r) for r in one_of_each(some).collect()))
    assert mixed[0] == mixed[1] == mixed[2] and ones[0] == ones[1] == ones[2]
    assert sum(ones[0].values()) == 63 and all(Counter(map(str, df.collect()))[r] >= k for r, k in ones[0].items())


def test_many_equal_rows_are_dealt_out(spark):
    """Rows equal in everything are numbered without meeting in one task: no partition of the numbering holds them all."""
    from pyspark.sql import functions as F

    from textloom.llm.mixing import mix_words

    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    got = mix_words(rows).agg(F.count("*"), F.sum("size"), F.max("taken"), F.sum("taken")).first()
    assert got[0] == 20_000 and got[1] == 60_000 and got[2] <= 6 and abs(got[3] - 90_000) <= 64
