"""Outliers of small groups."""

import random


def test_outliers_of_small_groups_go(spark):
    from textloom.llm.quality import judge

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    clean = lambda: " ".join(word() for _ in range(rng.randrange(60, 200)))
    stutter = lambda: " ".join(" ".join([word()] * 7) for _ in range(8))  # 48 of 56 words repeat the word before
    good, bad = [], []
    for source, n in (("large", 400), ("s5", 5), ("s12", 12), ("s25", 25), ("s65", 65)):
        for _ in range(n):
            good.append((len(good), clean(), "en", source))
        bad.append((1000 + len(bad), stutter(), "en", source))
    got = {r.doc_id: r for r in judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[b[0]].base_failed for b in bad)
    assert not any(got[b[0]].kept for b in bad), [b[3] for b in bad if got[b[0]].kept]
    assert all(got[g[0]].kept for g in good)


def test_least_determinants_against_all_subsets(spark):
    """Small groups: of all subsets of h rows the one of least determinant, by brute force."""
    import itertools

    import numpy as np

    from textloom.llm.quality import NAMES, consistent, least_determinants

    rng = np.random.default_rng(3)
    data, groups = [], {}
    for g in range(4):
        n = 11 + g
        x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6)) * 300
        x[:3] += rng.normal(size=6) * 9000 + 4000  # outliers
        groups[g] = np.round(x).astype(int)
        data += [(g, i % 7, *map(int, r)) for i, r in enumerate(groups[g])]
    rows = spark.createDataFrame(data, "g long, salt int, " + ", ".join(f"{a} long" for a in NAMES))
    got = {r.g: r for r in least_determinants(rows, share=0.65, whole=0, floor=1e-6)[0].collect()}
    equal = 0
    for g, x in groups.items():
        h = -(-len(x) * 65 // 100)
        found = min((np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) * consistent(0.65))[1], s) for s in itertools.combinations(range(len(x)), h))
        assert found[0] - 0.01 < got[g].logdet < found[0] + 1.5, (g, got[g].logdet, found)  # a search, like all for this estimate
        equal += np.allclose([got[g][f"m_{a}"] for a in NAMES], x[list(found[1])].mean(axis=0), rtol=1e-6)
    assert equal >= 2


def test_columns_of_any_name(spark):
    from textloom.llm.quality import keep

    text = " ".join(f"word{i}" for i in range(40))
    names = ["key", "_key", "_id", "g", "c0", "salt", "n_words", "kept", "a.b"]
    rows = [(i, text + f" {i}", "en", f"s{i % 2}", *(f"{n}{i}" for n in names)) for i in range(8)] + [(None, None, None, None, *names)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    got = keep(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(rows[:-1])


def test_same_text_of_two_sources(spark):
    """A text that is an outlier in one source and usual in another goes from the first only."""
    from textloom.llm.quality import keep

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    clean = [(i, " ".join(word() for _ in range(rng.randrange(60, 200))), "en", "clean") for i in range(300)]
    odd = [(1000 + i, " ".join(" ".join([word()] * 7) for _ in range(rng.randrange(7, 20))), "en", "odd") for i in range(300)]
    both = [(7777, odd[0][1], "en", "clean"), (7777, odd[0][1], "en", "odd")]
    got = keep(spark.createDataFrame(clean + odd + both, "doc_id long, text string, lang string, source string")).where("doc_id = 7777").collect()
    assert [r.source for r in got] == ["odd"]
