"""Words learnt from texts without spaces, and best paths against all paths."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators.metrics import similarity
from textloom.operators.words import HAN, best_path, learn_words, repetition_of_words, trie, with_words

LEXICON = ["中国", "人民", "共和国", "学习", "机器", "语言模型", "数据", "北京", "大学", "我们", "喜欢", "的", "在", "和", "是"]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    return [[rng.choice(LEXICON) for _ in range(rng.randint(5, 20))] for _ in range(n)]


def plain_words(runs, longest=4, least=5, cohesion=20.0, freedom=0.7):
    counts = Counter(r[i : i + n] for r in runs for n in range(1, longest + 2) for i in range(len(r) - n + 1))
    total = sum(k for w, k in counts.items() if len(w) == 1)
    out = {w: k for w, k in counts.items() if len(w) == 1}
    for w, k in counts.items():
        if not 2 <= len(w) <= longest or k < least:
            continue
        meets = min(k * total / counts[w[:i]] / counts[w[i:]] for i in range(1, len(w)))

        def entropy(neighbours):
            shares = [x / k for x in neighbours] + [1 / k] * (k - sum(neighbours))
            return -sum(p * math.log(p) for p in shares)

        after = [x for v, x in counts.items() if len(v) == len(w) + 1 and v.startswith(w)]
        before = [x for v, x in counts.items() if len(v) == len(w) + 1 and v.endswith(w)]
        if meets >= cohesion and min(entropy(after), entropy(before)) >= freedom:
            out[w] = k
    return out


def test_dictionary_and_cuts(spark):
    said = texts()
    rows = [(i, "".join(s), "clash") for i, s in enumerate(said)] + [(1000, None, "x"), (1001, "only latin words", "x"), (1002, "", "x")]
    df = spark.createDataFrame(rows, "id long, text string, word string").repartition(3)
    # words that recur are few here, so parts of them meet only some ten times oftener than by chance
    words = learn_words(df, cohesion=4.0)
    got = {r.word: r.n for r in words.collect()}
    assert got == plain_words(["".join(s) for s in said], cohesion=4.0)
    assert sum(math.exp(r.logp) for r in words.collect()) == pytest.approx(1)
    assert {"中国", "人民", "学习", "语言模型", "大学"} <= got.keys() and "国人" not in got
    cut = {r.id: r.words for r in with_words(df, words).collect()}
    right = sum(sum((Counter(cut[i]) & Counter(s)).values()) for i, s in enumerate(said))
    assert right > 0.9 * sum(map(len, said)) and cut[1000] is None and cut[1001] == ["only", "latin", "words"] and cut[1002] == []
    assert all("".join(cut[i]) == "".join(s) for i, s in enumerate(said))
    assert learn_words(df.limit(0)).count() == 0 and with_words(df.limit(2), learn_words(df.limit(0))).count() == 2


def test_best_paths_are_best():
    rng = random.Random(3)
    for _ in range(300):
        words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 3))): -rng.randint(1, 9) - rng.random() for _ in range(rng.randint(1, 9))}
        run = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(0, 9)))

        def paths(at):
            if at == len(run):
                yield 0.0
            for j in range(at + 1, len(run) + 1):
                w = run[at:j]
                logp = words.get(w, -50.0 if len(w) == 1 else None)
                if logp is not None:
                    for rest in paths(j):
                        yield logp + rest

        found = best_path(run, trie(words), -50.0)
        assert "".join(found) == run and sum(words.get(w, -50.0) for w in found) == pytest.approx(max(paths(0)))


def test_mixed_texts_repetition_and_similarity(spark):
    words = spark.createDataFrame([("中国", 1, -1.0), ("人民", 1, -1.0)], "word string, n long, logp double")
    df = spark.createDataFrame([(1, "AI在中国 ok，中国人民", "中国人民在"), (2, None, None)], "id int, text string, other string")
    cut = with_words(with_words(df, words), words, "other", "other_words")
    row = cut.where("id = 1").first()
    assert row.words == ["AI", "在", "中国", "ok，", "中国", "人民"] and row.other_words == ["中国", "人民", "在"]
    got = cut.select("id", repetition_of_words(F.col("words"), 1, -1.0).alias("one"), repetition_of_words(F.col("words"), 9, -1.0).alias("nine"))
    assert [(r.id, round(r.one, 6), r.nine) for r in got.orderBy("id").collect()] == [(1, round(-1 / 6, 6), 0.0), (2, 0.0, 0.0)]
    assert similarity(cut, "text", "other", ("words", "other_words")).where("id = 1").first().rouge_1 == pytest.approx(100 * 2 * 3 / 9, abs=1e-4)
    with pytest.raises(ValueError):
        repetition_of_words(F.col("words"), 1, 1.0)
    assert HAN.endswith("+")


def test_all_runs_of_characters(spark):
    """Every substring of up to so many characters with repeats, beyond 16 bits too, in a plan that searches no place in the text."""
    from collections import Counter

    from pyspark.sql import functions as F

    from textloom.operators.words import _grams

    texts = ["", "a", "añ𠀀", "ababab", "𠀀𠀁𠀀x中文"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(_grams(F.col("t"), m).alias(f"g{m}") for m in (1, 3, 5)))
    assert "substring" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        for m in (1, 3, 5):
            assert Counter(r[f"g{m}"]) == Counter(r.t[i : i + k] for k in range(1, m + 1) for i in range(len(r.t) - k + 1))
