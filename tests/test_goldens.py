"""Golden values of the operators, and their edges."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import alignment, metrics, packing, preparation, rewards, rules, scorer, utility, visibility


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def answer(parts):
    """Sentences of so many long words that cite these documents."""
    return "\n\n".join(" ".join(["word"] * n) + "".join(f"[{c}]" for c in cites) + "." for n, cites in parts)


@pytest.mark.parametrize(
    "parts,wordpos,word,pos",
    [
        ([(4, [0]), (2, [1, 0])], [0.922319, 0.077681, 0, 0, 0], [0.833333, 0.166667, 0, 0, 0], [0.865529, 0.134471, 0, 0, 0]),
        ([(4, [0]), (2, [1, 0]), (3, [7])], [0.883652, 0.116348, 0, 0, 0], [0.833333, 0.166667, 0, 0, 0], [0.811230, 0.188770, 0, 0, 0]),
        ([(5, [2, 2, 9])], [0, 0, 1, 0, 0], [0, 0, 1, 0, 0], [0, 0, 1, 0, 0]),
        ([(5, [])], [0.2] * 5, [0.2] * 5, [0.2] * 5),
    ],
)
def test_impressions(spark, parts, wordpos, word, pos):
    df = spark.createDataFrame([(1, answer(parts))], "key int, text string")
    got = visibility.with_impressions(df).first().scores
    assert [round(s.wordpos, 6) for s in got] == pytest.approx(wordpos) and [round(s.word, 6) for s in got] == pytest.approx(word) and [round(s.pos, 6) for s in got] == pytest.approx(pos)
    long = {r.slot: r for r in visibility.impressions_long(df).collect()}
    assert [long[s.slot].wordpos for s in got] == pytest.approx([s.wordpos for s in got])


def test_impressions_of_nothing(spark):
    got = visibility.with_impressions(spark.createDataFrame([(None,), ("",)], "text string")).collect()
    assert all(s.word == 0.2 for r in got for s in r.scores)


def test_citations(spark):
    assert one(spark, T.citations(F.lit("a [3] b [12] [x4]"))) == [3, 12]
    assert one(spark, T.citations(F.lit("[1, 2]"))) == []
    assert one(spark, T.citations(F.lit("[1][2]"))) == [1, 2]


@pytest.mark.parametrize("s,t,c,want", [(3000, 2000, 1000, (600, 400)), (2000, 3000, 1000, (400, 600)), (1000, 100, 1000, (900, 100)), (100, 1000, 1000, (100, 900)), (100, 500, 1000, (100, 500)), (500, 100, 1000, (500, 100)), (10, 10, 1000, (10, 10))])
def test_lengths(spark, s, t, c, want):
    assert tuple(one(spark, packing.infer_lengths(F.lit(s), F.lit(t), c))) == want


def test_alignment(spark):
    asked, said = [("user", "Solve the math problem.\n3 + 4")], [("assistant", "The answer is 7.")]
    a = alignment.alpaca(spark.createDataFrame([("Solve the math problem.", "3 + 4", "The answer is 7.")], "instruction string, input string, output string")).first()
    m = [("system", "You are a helpful assistant."), ("human", "Solve the math problem.\n3 + 4"), ("gpt", "The answer is 7.")]
    schema = "conversations array<struct<from:string,value:string>>"
    s = alignment.sharegpt(spark.createDataFrame([(m,)], schema)).first()
    for r, system in ((a, ""), (s, "You are a helpful assistant.")):
        assert ([tuple(x) for x in r._prompt], [tuple(x) for x in r._response], r._system, r._tools, r._images) == (asked, said, system, "", None)
    broken = [[("human", "a")], [("gpt", "a"), ("human", "b")], [("human", "a"), ("nobody", "b")], [], None]
    assert all(r._prompt == [] for r in alignment.sharegpt(spark.createDataFrame([(b,) for b in broken], schema)).collect()[:3])
    assert alignment.valid(alignment.sharegpt(spark.createDataFrame([(b,) for b in broken], schema))).count() == 0
    with pytest.raises(ValueError):
        alignment.converter("nothing")
    assert [tuple(x) for x in one(spark, alignment.alternating(F.array(*map(F.lit, "abc"))))] == [("human", "a"), ("gpt", "b")]
    assert [tuple(x) for x in one(spark, alignment.split_dialogue(F.lit("Human: hi\nAssistant: yo\nHuman:x")))] == [("human", "hi"), ("gpt", "yo"), ("human", "x")]
    got = one(spark, alignment.last_exchange(F.lit("\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: d")))
    assert (got.instruction, got.answer, got.history) == ("c", "d", [["a", "b"]])


@pytest.mark.parametrize("n,penalty,text,want", [(2, -1, "this is a this is a test", -1 / 3), (3, -2, "this is a this is a test", -0.4), (3, -1, "word word word word", -0.5), (3, -1, "A B C A B C", -0.25), (3, -1, "A B C A B C E F G A B C A B C", -0.3846), (3, -1, "", 0), (3, -1, "two words", 0)])
def test_repetition(spark, n, penalty, text, want):
    assert one(spark, rewards.repetition(F.lit(text), n, penalty)) == pytest.approx(want, abs=1e-4)
    with pytest.raises(ValueError):
        rewards.repetition(F.lit("x"), 3, 1.5)


def test_row_rewards(spark):
    full = "<think>\na\n</think>\n<answer>\nb\n</answer>"
    assert one(spark, rewards.thought_then_answer(F.lit(full))) == 1 and one(spark, rewards.thought_then_answer(F.lit(" " + full))) == 0
    assert one(spark, rewards.tag_count(F.lit(full))) == pytest.approx(1.34) and one(spark, rewards.tag_count(F.lit(full), 0.25)) == 1
    assert one(spark, rewards.tag_count(F.lit(full[8:]))) == pytest.approx(1.005)
    assert one(spark, rewards.reasoning_steps(F.lit("Step 1: a\nStep 2: b\nStep 3: c"))) == 1
    assert one(spark, rewards.reasoning_steps(F.lit("First, a. Second, b."))) == pytest.approx(2 / 3)
    for n, right in ((20, True), (80, True), (20, False), (80, False)):
        wave = 0.25 * (1 + math.cos(n / 100 * math.pi))
        assert one(spark, rewards.cosine(F.lit("x" * n), F.lit(right), 100)) == pytest.approx(0.5 + wave if right else -0.5 - wave)
    for n, want in ((50, 0), (110, -1), (90, -0.5)):
        assert one(spark, rewards.overlong(F.lit(n), 100, 20)) == want
    code = "<think>\na\n</think>\n<answer>\n```python\nx\n```\n</answer>"
    assert one(spark, rewards.code_format(F.lit(code), F.lit("python"))) == 1 and one(spark, rewards.code_format(F.lit(code), F.lit("cpp"))) == 0
    assert one(spark, rewards.accuracy(F.lit(r"so \boxed{0.50}"), F.lit("$0.5$"))) == 1 and one(spark, rewards.accuracy(F.lit("a"), F.lit("b"))) == 0
    assert one(spark, rewards.submission_score(F.lit(3), F.lit(3), F.lit(True), F.lit(True))) == pytest.approx(1.1)
    assert one(spark, rewards.submission_score(F.lit(0), F.lit(0), F.lit(True), F.lit(True))) is None


def test_masks(spark):
    for mask, lengths, offsets in (([1, 1, 2, 2, 2, 0], [2, 3], [0, 2, 5]), ([1, 2, 2, 3, 3, 3], [1, 2, 3], [0, 1, 3, 6])):
        m = F.array(*map(F.lit, mask))
        assert one(spark, packing.segment_lengths(m)) == lengths and one(spark, packing.cumulative(packing.segment_lengths(m))) == offsets
        assert one(spark, packing.block_mask(m)) == [[mask[i] == mask[j] and mask[i] != 0 and j <= i for j in range(6)] for i in range(6)]


def test_knapsack(spark):
    assert [[[3, 5, 2, 7, 4][i] for i in s] for s in packing.knapsack([3, 5, 2, 7, 4], 8)] == [[7], [5, 3], [4, 2]]
    rng = random.Random(0)
    for _ in range(50):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(40))]
        sacks = packing.knapsack(sizes, 20)
        assert sorted(i for s in sacks for i in s) == [i for i, n in enumerate(sizes) if n <= 20] and all(sum(sizes[i] for i in s) <= 20 for s in sacks)


def test_encoded_turns(spark):
    turns = [([1, 2, 3], [4, 5]), ([6], [7, 8, 9])]
    df = spark.createDataFrame([(turns,)], "t array<struct<prompt:array<int>,response:array<int>>>")
    got = df.select(packing.encode_turns(F.col("t"), 100, eos=0).alias("x")).first().x
    assert got.input_ids == [1, 2, 3, 4, 5, 6, 7, 8, 9, 0] and got.labels == [-100] * 3 + [4, 5, -100, 7, 8, 9, 0]
    got = df.select(packing.encode_turns(F.col("t"), 100, mask_history=True).alias("x")).first().x
    assert got.input_ids == [1, 2, 3, 4, 5, 6, 7, 8, 9] and got.labels == [-100] * 6 + [7, 8, 9]


def test_smooth(spark):
    assert one(spark, metrics.smooth(F.array(*map(F.lit, [1.0, 2.0, 4.0])))) == pytest.approx([1, 1.932626, 3.860713], abs=1e-5)
    assert one(spark, metrics.smooth(F.array().cast("array<double>"))) == []


def test_citation_quality(spark):
    q = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    j = [("a", 0, 0, "full_support"), ("a", 0, 1, "no_support"), ("a", 1, 0, "partial_support"), ("a", 2, None, None), ("c", 0, None, None), ("c", 1, None, None), ("d", 0, 99, None)]
    got = {r.key: (r.precision, r.recall) for r in utility.citation_quality(q, spark.createDataFrame(j, "key string, claim_id int, source_index int, label string")).collect()}
    assert got["a"] == pytest.approx((0.75, 2 / 3)) and got["b"] == (None, None) and got["c"] == (0, 0) and got["d"] == (0, 1)


def test_mixture(spark):
    a, b = spark.range(41).toDF("id"), spark.range(100, 131).toDF("id")
    build = lambda *p, **k: preparation.Mixture(list(p), "id", **k).build()
    assert build(preparation.Part(a), preparation.Part(b))["train"].count() == 72
    assert build(preparation.Part(a, 0.25), preparation.Part(b, 0.5))["train"].count() == 10 + 15
    parts = build(preparation.Part(spark.range(10).toDF("id")), test=0.2)
    assert (parts["train"].count(), parts["test"].count()) == (8, 2)
    with pytest.raises(ValueError):
        preparation.Mixture([preparation.Part(a), preparation.Part(b.toDF("other"))], "id")
    assert preparation.exact_sample(a, "id", 100).count() == 100 and preparation.exact_sample(a, "id", 7).count() == 7
    over = preparation.interleave([a, b], ["id"], "interleave_over", [0.3, 0.7]).collect()
    assert {r.id for r in over} == {*range(41), *range(100, 131)} and sorted(r._at for r in over) == list(range(len(over)))
    with pytest.raises(ValueError):
        preparation.DataArguments(streaming=True, val_size=0.5)


def test_text(spark):
    assert one(spark, T.formal_text(F.lit("<think>x</think> a <|im_end|>"))) == "a"
    assert one(spark, T.add_thought(T.remove_thought(F.lit("<think>\nx\n</think>\n\nb")))) == "<think>\n\n</think>\n\nb"
    assert one(spark, T.parse_rule_list(F.lit('x ["a", " ", "b"] y'))) == ["a", "b"] and one(spark, T.parse_rule_list(F.lit('- "a" and "b"'))) == ["a", "b"]
    assert one(spark, T.method_name(F.lit("rewrite_api"), F.lit("Some-Set x"), F.lit("gpt"))) == "rewrite_api_some_set_x_gpt"
    assert tuple(one(spark, T.parse_method_name(F.lit("Rewrite_API_some_set_gpt"), ["rewrite", "Rewrite_API"]))) == ("rewrite_api", "some-set", "gpt")
    assert one(spark, T.parse_method_name(F.lit("other_set_gpt"), ["rewrite"])) is None
    assert one(spark, T.verdict(F.lit(0.0), F.lit("Time limit exceeded"))) == "TLE" and one(spark, T.verdict(F.lit(0.4), F.lit(None).cast("string"))) == "PA"
    assert one(spark, T.trim_padding(F.array(*map(F.lit, [0, 0, 5, 0, 6])), 0)) == [5, 0, 6] and one(spark, T.trim_padding(F.array(*map(F.lit, [5, 0, 0])), 0, "right")) == [5]
    assert one(spark, T.word_ngrams(F.lit("a b c"), 2)) == ["a b", "b c"] and one(spark, T.word_ngrams(F.lit("a"), 2)) == []


def test_rules(spark):
    assert json.loads(rules.repair_json('```json\n["say "hi" now", "b"]\n```')) == ['say "hi" now', "b"]
    rows = spark.createDataFrame([(["b two three x", "a one"],), (["b two three y", " "],)], "rules array<string>")
    got = {r.rule for r in rules.merge_rules(rows, rules.keep_first_words, budget=4).collect()}
    assert got == {"b two three x", "a one"}
    assert {r.rule for r in rules.merge_rules(rows.limit(0), rules.keep_first_words).collect()} == set()


def test_scorer(spark, tmp_path):
    def call(p):
        if p == "bad":
            raise OSError("down")
        return p.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "bad")], "id int, prompt string")
    got = {r.id: r for r in scorer.score_once(rows, str(tmp_path / "s"), ["id"], call, tries=2, wait=0.01).collect()}
    assert got[1].response == "A" and got[2].error == "OSError: down"
    more = spark.createDataFrame([(1, "changed"), (3, "c")], "id int, prompt string")
    got = {r.id: r.response for r in scorer.score_once(more, str(tmp_path / "s"), ["id"], call).collect()}
    assert got == {1: "A", 2: None, 3: "C"}


def test_metrics(spark):
    rows = spark.createDataFrame([("the cat sat", "the cat sat"), ("", "x"), ("a b", "c d")], "p string, t string")
    got = metrics.similarity(rows, "p", "t").collect()
    assert got[0].rouge_1 == got[0].rouge_l == 100 and got[0].bleu_4 == pytest.approx(100) and got[1].rouge_1 == 0 and got[2].rouge_2 == 0
    assert one(spark, metrics.token_accuracy(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [-100, 1, 9])))) == 0.5
    assert one(spark, metrics.perplexity(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(1), F.lit(0)))) == pytest.approx(math.e)
