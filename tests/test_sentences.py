"""The learnt sentence splitter against a plain trainer and splitter, and on texts whose ends are known."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators.sentences import train, with_sentences
from textloom.operators.visibility import with_impressions

OPEN = re.compile(r"""^["'“‘«„(\[{]+""")
SHUT = re.compile(r"""(?:\[[^A-Za-z0-9_\s]*[0-9]+[^A-Za-z0-9_\s]*\]|["'”’»)\]}])+$""")
LETTER = r"[^\W\d_]"


def tokens(text):
    out = []
    for chunk in re.split(r"(?<=[ \t\n\x0b\f\r])(?=[^ \t\n\x0b\f\r])", text):
        core = SHUT.sub("", OPEN.sub("", re.sub(r"[ \t\n\x0b\f\r]+\Z", "", chunk)))
        base = re.sub(r"[.,;:!?…]+\Z", "", core).lower()
        mark = "!" if core[-1:] in ("!", "?") and core else "…" if core.endswith(("..", "…")) else "." if core.endswith(".") else ""
        case = "U" if core[:1].isupper() else "l" if core[:1].islower() else "-"
        base = "##" if re.fullmatch(r"[+-]?[0-9][0-9.,:/-]*", base) else base
        out.append((chunk, base, mark, bool(re.search(r"\n[ \t\x0b\f\r]*\n", chunk)), case))
    return out


def ll(k, n, p):
    return sum(c * math.log(max(q, 1e-300)) for c, q in ((k, p), (n - k, 1 - p)) if c > 0)


def ratio(a, b, both, n):
    p, p1, p2 = b / n, both / a, (b - both) / (n - a) if n > a else 0.0
    return -2 * (ll(both, a, p) + ll(b - both, n - a, p) - ll(both, a, p1) - ll(b - both, n - a, p2)) if p1 > p else 0.0


class Plain:
    def __init__(self, texts):
        every = [tokens(t) for t in texts if t is not None]
        n, dotted = Counter(), Counter()
        for ts in every:
            for _, base, mark, _, _ in ts:
                if base:
                    n[base] += 1
                    dotted[base] += mark == "."
        total, periods = sum(n.values()), sum(dotted.values())
        self.short = set()
        for base, k in dotted.items():
            inner = base.count(".")
            letters = len(base) - inner
            if k and re.search(LETTER, base):
                score = -2 * (ll(k, n[base], periods / total) - ll(k, n[base], 0.99)) * math.exp(-letters) * (inner + 1) * float(letters) ** -(n[base] - k)
                if score >= 0.3:
                    self.short.add(base)
        self.seen, started = defaultdict(Counter), Counter()
        both, contexts = Counter(), set()
        for ts in every:
            for a, b in zip([(None, "", "!", True, "-"), *ts], ts):
                before = self.before(a)
                end = (a[3] or a[2] == "!") if before is None else not self.is_short(before) and not self.odd(before)
                if b[1]:
                    w = self.seen[b[1]]
                    w["upper"] += b[4] == "U"
                    w["inside"] += b[4] == "U" and not end
                    w["lower"] += b[4] == "l"
                    w["begin_lower"] += b[4] == "l" and end
                    started[b[1]] += end and before is not None
                if before is not None:
                    both[before, b[1]] += 1
                    contexts.add((before, b[1], b[4]))
        ends = sum(started.values())
        self.starters = {b for b, k in started.items() if k and re.match(LETTER, b) and ratio(ends, n[b], k, total) >= 30}
        self.joined = set()
        for before, after, case in contexts:
            if not self.is_short(before) and not self.odd(before):
                continue
            pair = before in n and after in n and both[before, after] > 1 and ratio(dotted[before], n[after], both[before, after], total) >= 7.88
            w = self.seen.get(after, Counter())
            breaks = case == "U" and w["lower"] > 0 and w["inside"] == 0
            joins = case == "l" and (w["upper"] > 0 or w["begin_lower"] == 0)
            begins = breaks or case == "U" and after in self.starters
            name = re.fullmatch(LETTER, before) and case == "U" and not breaks and w["lower"] == 0
            if (pair or joins or name or self.is_short(before) and not begins) if self.odd(before) else not begins:
                self.joined.add((before, after, case))

    @staticmethod
    def before(a):
        return None if a[3] or a[2] not in (".", "…") else "…" if a[2] == "…" else a[1]

    @staticmethod
    def odd(before):
        return before == "##" or bool(re.fullmatch(LETTER, before))

    def is_short(self, before):
        return before == "…" or before in self.short

    def split(self, text):
        if text is None:
            return []
        ts, out, now = tokens(text), [], ""
        for i, t in enumerate(ts):
            now += t[0]
            end = i == len(ts) - 1 or t[3] or t[2] == "!"
            if not end and t[2]:
                end = (self.before(t), ts[i + 1][1], ts[i + 1][4]) not in self.joined
            if end:
                out.append(now)
                now = ""
        return [s for s in (re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", s) for s in out) if s]


def english(n=400, seed=1):
    """Texts with abbreviations, initials, numbers and ellipses, and their sentences."""
    rng = random.Random(seed)
    words = "house river stone market garden evening letter winter road bridge window paper".split()
    names = ["Smith", "Miller", "Brown", "Fischer"]
    made = []
    for _ in range(n):
        sentences = []
        for _ in range(rng.randint(2, 7)):
            w = [rng.choice(words) for _ in range(rng.randint(4, 9))]
            k = rng.random()
            if k < 0.25:
                w.insert(2, f"{rng.choice(['Dr.', 'Mr.', 'Prof.'])} {rng.choice(names)}")
            elif k < 0.4:
                w.insert(2, f"{rng.choice('JKL')}. {rng.choice(names)}")
            elif k < 0.5:
                w.insert(3, "e.g. the " + rng.choice(words))
            elif k < 0.55:
                w.insert(2, f"on the {rng.randint(1, 30)}. of May")
            sentences.append(rng.choice(["The", "A", "Then", "But"]) + " " + " ".join(w) + rng.choice([".", ".", ".", "!", "?", '."']))
        made.append(sentences)
    return made


@pytest.mark.parametrize("kind", ["english", "documents"])
def test_model_and_sentences(spark, sf, kind):
    if kind == "english":
        texts = [" ".join(s) for s in english()] + [None, "", "  \n ", "One. \n\nnext... And 3. more (etc.) [2] x.", "J. S. Bach e.g. K. Miller."]
    else:
        texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "id long, text string, held string, key int").repartition(3)
    model, plain = train(df), Plain(texts)
    types = model.types.collect()
    assert {r.base for r in types if r.abbreviation} == plain.short
    assert {r.base for r in types if r.starter} == plain.starters
    assert {tuple(r) for r in model.joined.collect()} == plain.joined
    got = with_sentences(df, model)
    assert got.columns == [*df.columns, "sentences"]
    assert {r.id: r.sentences for r in got.collect()} == {i: plain.split(t) for i, t in enumerate(texts)}


def test_ends_that_are_known(spark):
    made = english(600, 5)
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(made)], "id long, text string")
    model = train(df)
    got = {r.id: r.sentences for r in with_sentences(df, model).collect()}
    assert {"dr", "mr", "prof", "e.g"} <= {r.base for r in model.types.where("abbreviation").collect()}
    right = sum(len(set(got[i]) & set(s)) for i, s in enumerate(made))
    assert right > 0.98 * sum(map(len, made)) and right > 0.98 * sum(map(len, got.values()))


def test_without_texts(spark):
    df = spark.createDataFrame([(1, None)], "id long, text string")
    for t in (df, df.limit(0)):
        model = train(t)
        assert model.joined.count() == 0
    some = spark.createDataFrame([(1, "One. two! Three"), (2, None)], "id long, text string")
    assert {r.id: r.sentences for r in with_sentences(some, model).collect()} == {1: ["One.", "two!", "Three"], 2: []}


def test_impressions_of_learnt_sentences(spark):
    texts = [" ".join(s) for s in english()]
    model = train(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    answer = spark.createDataFrame([(1, "The house of Dr. Smith stood there.[0] The road ended.[1] A bridge![0][1]")], "id long, text string")
    row = with_impressions(with_sentences(answer, model), n=2, split="sentences").first()
    assert [s for s in row.sentences] == ["The house of Dr. Smith stood there.[0]", "The road ended.[1]", "A bridge![0][1]"]
    words, decay = [5, 3, 1], [math.exp(-i / 2) for i in range(3)]
    a, b = words[0] * decay[0] + words[2] * decay[2] / 2, words[1] * decay[1] + words[2] * decay[2] / 2
    assert [s.wordpos for s in row.scores] == pytest.approx([a / (a + b), b / (a + b)])
