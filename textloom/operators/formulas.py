r"""Whether two answers are the same formula: LaTeX is read into an exact normal form, and normal forms are compared.

A value is a quotient of polynomials with rational coefficients. Monomials are powers, with rational exponents, of
variables, primes (so that ``\sqrt{12}`` is ``2\sqrt{3}``), the imaginary unit, and whatever else is opaque (functions,
roots of sums) named by its own normal form. Two quotients are equal if cross products are. Around values there are sets,
lists, tuples and intervals. Decimals are compared to six places.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ..ship import ship

Mono = tuple[tuple[str, Fraction], ...]
Poly = dict[Mono, Fraction]
MOST_TERMS = 4000
FUNCTIONS = {r"\sin", r"\cos", r"\tan", r"\cot", r"\sec", r"\csc", r"\arcsin", r"\arccos", r"\arctan", r"\log", r"\ln", r"\exp"}
GREEK = {r"\alpha", r"\beta", r"\gamma", r"\theta", r"\phi", r"\lambda", r"\mu", r"\sigma", r"\omega", r"\pi", r"\infty", r"\varnothing", r"\emptyset"}


#: Sums under roots by their names, of the pair that is compared.
_sums: dict[str, dict] = {}


class Unreadable(ValueError):
    pass


def _power(atom: str, e: Fraction) -> tuple[Fraction, Mono]:
    """A power of an atom as a factor and a reduced monomial: whole powers of primes are numbers, i * i is -1."""
    if atom.isdigit():
        whole = math.floor(e)
        return Fraction(int(atom)) ** whole, ((atom, e - whole),) if e != whole else ()
    if atom == "i" and e.denominator == 1:
        return Fraction(-1 if e % 4 in (2, 3) else 1), ((atom, Fraction(1)),) if e % 2 else ()
    return Fraction(1), ((atom, e),) if e else ()


def _times(a: Poly, b: Poly) -> Poly:
    out: Poly = {}
    for m, x in a.items():
        for n, y in b.items():
            exponents = dict(m)
            for atom, e in n:
                exponents[atom] = exponents.get(atom, Fraction(0)) + e
            factor, mono, whole = x * y, [], []
            for atom, e in exponents.items():
                if atom in _sums and e >= 1:  # a root of a sum, often enough to be the sum
                    whole += [_sums[atom]] * math.floor(e)
                    e -= math.floor(e)
                f, reduced = _power(atom, e)
                factor *= f
                mono += reduced
            term = {tuple(sorted(mono)): factor}
            for p in whole:
                term = _times(term, p)
            for key, z in term.items():
                out[key] = out.get(key, Fraction(0)) + z
    if len(out) > MOST_TERMS:
        raise Unreadable("too many terms")
    return {m: x for m, x in out.items() if x}


def _plus(a: Poly, b: Poly) -> Poly:
    out = dict(a)
    for m, x in b.items():
        out[m] = out.get(m, Fraction(0)) + x
    return {m: x for m, x in out.items() if x}


class Value:
    """A quotient of polynomials; ``rounded``: a decimal is in it."""

    def __init__(self, top: Poly, bottom: Poly | None = None, rounded: bool = False):
        self.top, self.bottom, self.rounded = top, bottom or {(): Fraction(1)}, rounded

    @classmethod
    def number(cls, x, rounded: bool = False) -> Value:
        return cls({(): Fraction(x)} if x else {}, None, rounded)

    @classmethod
    def atom(cls, name: str) -> Value:
        return cls({((name, Fraction(1)),): Fraction(1)})

    def _with(self, other: Value, top: Poly, bottom: Poly) -> Value:
        return Value(top, bottom, self.rounded or other.rounded)

    def __add__(self, o: Value) -> Value:
        if self.bottom == o.bottom:
            return self._with(o, _plus(self.top, o.top), self.bottom)
        return self._with(o, _plus(_times(self.top, o.bottom), _times(o.top, self.bottom)), _times(self.bottom, o.bottom))

    def __neg__(self) -> Value:
        return Value({m: -x for m, x in self.top.items()}, self.bottom, self.rounded)

    def __mul__(self, o: Value) -> Value:
        return self._with(o, _times(self.top, o.top), _times(self.bottom, o.bottom))

    def __truediv__(self, o: Value) -> Value:
        if not o.top:
            raise Unreadable("divided by zero")
        return self._with(o, _times(self.top, o.bottom), _times(self.bottom, o.top))

    def rational(self) -> Fraction | None:
        if set(self.top) <= {()} and set(self.bottom) == {()}:
            return self.top.get((), Fraction(0)) / self.bottom[()]
        return None

    def __pow__(self, o: Value) -> Value:
        e = o.rational()
        if e is None:
            return Value.atom(f"({self.name()})^({o.name()})")
        if e.denominator == 1 and abs(e) <= 200:
            out, base = Value.number(1), self if e >= 0 else Value.number(1) / self
            for _ in range(abs(int(e))):
                out = out * base
            return out
        return self._root(self.top, e) / self._root(self.bottom, e)

    def _root(self, p: Poly, e: Fraction) -> Value:
        if len(p) != 1:  # a sum: its whole powers are multiplied out, the rest is named
            if not p:
                return Value.number(0)
            whole = math.floor(e)
            if abs(whole) > 200:
                raise Unreadable("a large power")
            name = f"({_named(p)})"
            _sums[name] = p
            return Value(p, None, self.rounded) ** Value.number(whole) * Value({((name, e - whole),): Fraction(1)})
        ((mono, x),) = p.items()
        out = Value.number(1, self.rounded)
        if x < 0:
            if e.denominator % 2:
                out = -out if e.numerator % 2 else out
            elif e.denominator == 2:
                out = Value.atom("i") ** Value.number(e.numerator)
            else:
                raise Unreadable("a root of a negative number")
        factors = [(p_, k) for n, sign in ((abs(x.numerator), 1), (x.denominator, -1)) for p_, k in _primes(n, sign)]
        for atom, k in [*((str(p_), Fraction(k)) for p_, k in factors), *mono]:
            f, m = _power(atom, k * e)
            out = out * Value({m: f})
        return out

    def name(self) -> str:
        r = self.rational()
        return str(r) if r is not None else f"{_named(self.top)}/{_named(self.bottom)}"

    def near(self) -> float | None:
        """The value as a float, where nothing is unknown in it."""

        def of(p: Poly) -> float:
            total = 0.0
            for mono, x in p.items():
                for atom, e in mono:
                    x = x * {r"\pi": math.pi, "e": math.e}[atom] ** float(e) if not atom.isdigit() else x * int(atom) ** float(e)
                total += float(x)
            return total

        try:
            return of(self.top) / of(self.bottom)
        except (KeyError, OverflowError, ZeroDivisionError):
            return None

    def __eq__(self, o) -> bool:
        if not isinstance(o, Value):
            return False
        if self.rounded or o.rounded:
            a, b = self.near(), o.near()
            if a is not None and b is not None:
                return abs(round(a, 6) - round(b, 6)) < 5e-7
        return _times(self.top, o.bottom) == _times(o.top, self.bottom)

    __hash__ = None


def _named(p: Poly) -> str:
    return "+".join(f"{x}" + "".join(f"*{a}^{e}" for a, e in m) for m, x in sorted(p.items()))


def _primes(n: int, sign: int) -> Iterator[tuple[int, int]]:
    if n > 10**12:
        raise Unreadable("a root of a large number")
    p = 2
    while n > 1:
        k = 0
        while n % p == 0:
            n, k = n // p, k + 1
        if k:
            yield p, k * sign
        p = n if p * p > n and n > 1 else p + 1


# What does not change a value: spacing, sizes of brackets, units, degrees, dollar and percent signs.
_NOTHING = re.compile(r"\\(?:left|right|displaystyle|big|Big|bigg|Bigg|quad|qquad|[!,;: ])(?![a-zA-Z])|\\(?:text|mathrm|mbox|textrm)\s*\{[^{}]*\}|\^\s*\{?\s*\\circ\s*\}?|\\degree|\\?%|\\?\$|~")
_TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?|\.\d+|\\[a-zA-Z]+|\\[{}|]|[a-zA-Z]|[-+*/^_(){}\[\]|!=,])")


def _tokens(text: str) -> list[str]:
    text = _NOTHING.sub(" ", text).replace("{,}", "").strip().rstrip(".")
    text = re.sub(r"(?<![\d.])\d{1,3}(?:,\d{3})+(?!\d)", lambda m: m[0].replace(",", ""), text)
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(text[at : at + 10])
        out.append({r"\dfrac": r"\frac", r"\tfrac": r"\frac", r"\cdot": "*", r"\times": "*", r"\div": "/"}.get(m[1], m[1]))
        at = m.end()
    return out


class Reader:
    """One formula, read by descent."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        t = self.peek()
        if not t or wanted and t not in wanted:
            raise Unreadable(f"{t} for {wanted}")
        self.at += 1
        return t

    def sum(self) -> Value:
        sign = self.take() if self.peek() in ("+", "-") else "+"
        out = self.product() if sign == "+" else -self.product()
        while self.peek() in ("+", "-"):
            out = out + self.product() if self.take() == "+" else out + -self.product()
        return out

    def product(self) -> Value:
        out = self.factor()
        while (t := self.peek()) and t not in ("+", "-", ")", "}", "]", r"\}", ",", "=", "|", r"\cup"):
            if t in ("*", "/"):
                self.take()
                right = -self.factor() if self.peek() == "-" and self.take() else self.factor()
                out = out * right if t == "*" else out / right
            else:
                out = out * self.factor()
        return out

    def factor(self) -> Value:
        whole = self.peek().isdigit()
        out = self.base()
        if whole and self.peek() == r"\frac" and (part := self._proper()):  # 1\frac{1}{2}
            out = out + part
        while self.peek() in ("^", "!"):
            if self.take() == "^":
                out = out ** self.argument()
            else:
                n = out.rational()
                if n is None or n.denominator != 1 or not 0 <= n <= 300:
                    raise Unreadable("a factorial")
                out = Value.number(math.factorial(int(n)))
        return out

    def _proper(self) -> Value | None:
        mark = self.at
        part = self.base()
        r = part.rational()
        if r is not None and 0 < r < 1:
            return part
        self.at = mark
        return None

    def argument(self) -> Value:
        """In braces, or one token: the first digit of a number."""
        t = self.peek()
        if t == "{":
            return self.group("}")
        if t == "-":
            self.take()
            return -self.argument()
        if t.isdigit() and len(t) > 1:
            self.tokens[self.at : self.at + 1] = [t[0], t[1:]]
        return self.base()

    def group(self, close: str) -> Value:
        self.take()
        out = self.sum()
        self.take(close)
        return out

    def base(self) -> Value:
        t = self.peek()
        if t in ("(", "{", "["):
            return self.group({"(": ")", "{": "}", "[": "]"}[t])
        if t == "|":
            inside = self.group("|")
            r = inside.rational()
            return Value.number(abs(r), inside.rounded) if r is not None else Value.atom(f"|{inside.name()}|")
        self.take()
        if t[0].isdigit() or t[0] == ".":
            return Value.number(Fraction(t), "." in t)
        if t == r"\frac":
            return self.argument() / self.argument()
        if t == r"\binom":
            n, k = self.argument().rational(), self.argument().rational()
            if n is None or k is None or n.denominator * k.denominator != 1 or not 0 <= k <= n <= 300:
                raise Unreadable("a binomial")
            return Value.number(math.comb(int(n), int(k)))
        if t == r"\sqrt":
            n = Value.number(2)
            if self.peek() == "[":
                n = self.group("]")
            return self.argument() ** (Value.number(1) / n)
        if t in FUNCTIONS:
            power = None
            low = ""
            while self.peek() in ("^", "_"):
                if self.take() == "^":
                    power = self.argument()
                else:
                    low = self.argument().name()
            inside = self.group(")") if self.peek() == "(" else self.factor()
            out = Value.atom(f"{t}_{low}({inside.name()})")
            return out if power is None else out ** power
        if t.isalpha() or t in GREEK:
            name = t
            if self.peek() == "_":
                self.take()
                name += "_" + self.argument().name()
            return Value.atom(name)
        raise Unreadable(t)


def _parts(tokens: list[str], mark: str) -> list[list[str]]:
    """Cut at ``mark`` outside of all brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += t in ("(", "[", "{", r"\{")
        depth -= t in (")", "]", "}", r"\}")
        if t == mark and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _read(tokens: list[str]):
    if not tokens:
        raise Unreadable("nothing")
    if len(sides := _parts(tokens, r"\cup")) > 1:
        return ("set", [_read(s) for s in sides])
    tokens = _parts(tokens, "=")[-1]  # x = 5
    if len(items := _parts(tokens, ",")) > 1:
        return ("set", [_read(s) for s in items])
    if tokens and tokens[0] == r"\{" and tokens[-1] == r"\}":
        return ("set", [_read(s) for s in _parts(tokens[1:-1], ",") if s])
    if tokens and tokens[0] in ("(", "[") and tokens[-1] in (")", "]") and len(items := _parts(tokens[1:-1], ",")) > 1:
        return (tokens[0] + tokens[-1], [_read(s) for s in items])
    reader = Reader(list(tokens))
    out = reader.sum()
    if reader.at < len(reader.tokens):
        raise Unreadable(reader.peek())
    return out


def read(text: str):
    """The normal form of a formula: a value, or (kind, entries) with kind ``set`` or a pair of brackets."""
    try:
        return _read(_tokens(text))
    except (RecursionError, OverflowError) as e:
        raise Unreadable(str(e)) from e


def equal(a, b) -> bool:
    if isinstance(a, Value) or isinstance(b, Value):
        return isinstance(a, Value) and a == b
    if a[0] != b[0] or len(a[1]) != len(b[1]):
        return False
    if a[0] != "set":
        return all(equal(x, y) for x, y in zip(a[1], b[1], strict=True))
    left = list(b[1])
    for x in a[1]:
        at = next((i for i, y in enumerate(left) if equal(x, y)), None)
        if at is None:
            return False
        left.pop(at)
    return True


def boxed(text: str) -> str | None:
    r"""What the last ``\boxed`` holds, braces in braces included."""
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth, start = 1, at + 7
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[start:i]
    return None


def answer_of(text: str) -> str | None:
    """The box of an answer, or else the last formula between dollar signs or formula brackets."""
    found = boxed(text)
    if found is None:
        between = re.findall(r"\$\$(.+?)\$\$|\$(.+?)\$|\\\((.+?)\\\)|\\\[(.+?)\\\]", text, re.DOTALL)
        found = next(filter(None, between[-1])) if between else None
    return found


def _solution(text: str) -> str:
    """A solution's formula; without brackets around it the whole, unless it has words."""
    found = answer_of(text)
    if found is None and re.search(r"[a-zA-Z]{3,}", re.sub(r"\\[a-zA-Z]+", " ", _NOTHING.sub(" ", text))):
        raise Unreadable("words")
    return text if found is None else found


def same(text: str | None, solution: str | None) -> float | None:
    """1 if the answer in ``text`` is the solution, 0 if not or if it cannot be read; None where there is no solution that can be read."""
    _sums.clear()
    try:
        gold = read(_solution(solution)) if solution else None
    except Unreadable:
        gold = None
    if gold is None:
        return None
    try:
        found = answer_of(text or "")
        return float(found is not None and equal(gold, read(found)))
    except Unreadable:
        return 0.0


def with_formula_accuracy(rows: DataFrame, text: str, solution: str, out: str = "reward") -> DataFrame:
    """Adds ``out``: :func:`same` of each row, over batches; pairs that repeat in a batch are compared once."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict = {}
            values = []
            for pair in zip(b[text], b[solution], strict=True):
                if pair not in known:
                    known[pair] = same(*pair)
                values.append(known[pair])
            yield b.assign(**{out: pd.array(values, dtype="Float64")})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, DoubleType())]))
