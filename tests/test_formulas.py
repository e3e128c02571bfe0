"""Formulas that are equal, formulas that are not, and random ones against exact evaluation."""

import random
from fractions import Fraction

import pytest

from textloom.operators.formulas import Unreadable, equal, read, same, with_formula_accuracy

EQUAL = [
    (r"\frac{63}{400}", r"63/400"), (r"\dfrac12", "0.5"), (r"\sqrt{12}", r"2\sqrt{3}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}"), (r"\sqrt{2}\sqrt{3}", r"\sqrt 6"),
    (r"(x+1)^2", "x^2+2x+1"), (r"\frac{x^2-1}{x-1}", "x+1"), (r"2\pi r", r"r\cdot 2 \pi"), (r"1\frac{1}{2}", r"\frac32"), (r"10{,}000", "10,000"), (r"x = 5", "5"), (r"50\%", "50"), (r"90^\circ", "90"),
    (r"3\text{ cm}", "3"), (r"\{1, 2\}", r"\{2,1\}"), ("(1,2)", r"\left(1, \frac{4}{2}\right)"), (r"[0,1)\cup(2,3]", r"(2,3] \cup [0, 1)"), ("2, 3", "3,2"), (r"\sin^2(x)", r"\sin(x)\sin x"),
    (r"\sqrt[3]{16}", r"2\sqrt[3]{2}"), (r"i^2", "-1"), (r"\sqrt{-4}", "2i"), (r"5!", "120"), (r"\binom{5}{2}", "10"), (r"|{-3}|", "3"), (r"0.333333", r"\frac13"), (r"\frac{1}{1+\sqrt{2}}", r"\sqrt{2}-1"),
    (r"x^{\frac12}", r"\sqrt{x}"), (r"\sqrt{x+1}^2", "x+1"), (r"\log_2 8", r"\log_{2}{8}"), (r"a_1+a_2", "a_2+a_1"), (r"2^{10}", "1024"), (r"-\frac{1}{2}", r"\frac{-1}{2}"), (r"(-\infty, 3)", r"(-\infty,3)"), ("e^x e^y", "e^y e^x"),
]
UNEQUAL = [(r"\frac{64}{400}", r"\frac{63}{400}"), ("3", "6"), ("(1,2)", "(2,1)"), ("(1,2)", "[1,2)"), (r"\{1,2\}", r"\{1,2,2\}"), ("x+1", "x-1"), (r"\sqrt{2}", "1.4142"), ("xy", "x+y"), (r"\sin(x)", r"\cos(x)"), (r"\{1\}", "1"), ("0.33", r"\frac13")]


@pytest.mark.parametrize("a,b", EQUAL)
def test_equal(a, b):
    assert equal(read(a), read(b)) and equal(read(b), read(a))


@pytest.mark.parametrize("a,b", UNEQUAL)
def test_unequal(a, b):
    assert not equal(read(a), read(b))


def test_random_formulas_by_their_values():
    """Two spellings of one tree are equal; a tree that has another value somewhere is not."""
    rng = random.Random(4)

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice(["x", "y", str(rng.randint(1, 9))])
        return (rng.choice("+-*/^"), tree(depth - 1), tree(depth - 1))

    def tex(t, style):
        if isinstance(t, str):
            return t if style % 2 else f"{{{t}}}"
        op, a, b = t
        if op == "^":
            return f"({tex(a, style)})^{{{1 + len(str(b)) % 3}}}"
        a, b = tex(a, style + 1), tex(b, style)
        if op == "/":
            return rf"\frac{{{a}}}{{{b}}}" if style % 2 else f"({a})/({b})"
        if op in "+*" and style % 3 == 0:
            a, b = b, a
        return rf"\left({a}\right) {op} ({b})" if op != "*" else (rf"({a}) \cdot ({b})" if style % 2 else f"({a})({b})")

    def value(t, at):
        if isinstance(t, str):
            return at.get(t) or Fraction(t)
        op, a, b = t
        x = value(a, at)
        if op == "^":
            return x ** (1 + len(str(b)) % 3)
        y = value(b, at)
        return x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x / y

    checked = 0
    for _ in range(400):
        t, u = tree(3), tree(3)
        try:
            assert equal(read(tex(t, 0)), read(tex(t, 3)))
            points = [{"x": Fraction(rng.randint(50, 99), 7), "y": Fraction(rng.randint(50, 99), 11)} for _ in range(3)]
            assert equal(read(tex(t, 1)), read(tex(u, 2))) == all(value(t, p) == value(u, p) for p in points)
            checked += 1
        except (Unreadable, ZeroDivisionError):
            pass
    assert checked > 300


def test_answers(spark):
    cases = [
        (r"so \boxed{\frac{63}{400}}", r"\frac{63}{400}", 1.0), (r"\boxed{\frac{64}{400}}", r"\frac{63}{400}", 0.0), (r"\boxed{3}", "6", 0.0), (r"\boxed{1} then \boxed{\sqrt{\frac{1}{4}}}", "$0.5$", 1.0),
        ("no formula 6", "6", 0.0), ("it is $6$.", "6", 1.0), (r"\boxed{@}", "6", 0.0), (r"\boxed{6", "6", 0.0), (r"\boxed{6}", "@ unreadable @", None), (r"\boxed{answer}", "unparseable_latex", None), (r"\boxed{6}", "see the text", None), (r"\boxed{6}", None, None), (None, "6", 0.0), (r"\boxed{}", "6", 0.0), (r"\boxed{6}", "", None),
        (r"\boxed{(x+1)^{100000}}", "x", 0.0), (r"\boxed{" + "(" * 5000 + ")" * 5000 + "}", "x", 0.0),
    ]
    for text, solution, want in cases:
        assert same(text, solution) == want, (text, solution)
    rows = spark.createDataFrame([(i, a, b, "clash") for i, (a, b, _) in enumerate(cases)], "id int, text string, solution string, known string")
    got = with_formula_accuracy(rows, "text", "solution").orderBy("id").collect()
    assert [r.reward for r in got] == [w for *_, w in cases]
