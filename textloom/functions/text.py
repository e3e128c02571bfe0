"""Scalar text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A mark that texts do not contain, put between sentences before they are split.
MARK = "\x01"
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]"
CITATION = r"\[[^\w\s]*\d+[^\w\s]*\]"


def paragraphs(text: Column) -> Column:
    """Parts between blank lines."""
    return F.split(text, "\n\n")


def sentences(text: Column) -> Column:
    """Non-empty sentences: a paragraph is cut after ``.``, ``!`` or ``?`` before white space. (A rule of our own for a trained tokenizer.)"""
    cut = F.flatten(F.transform(paragraphs(text), lambda p: F.split(F.regexp_replace(p, SENTENCE_END, "$1" + MARK), MARK)))
    return F.filter(cut, lambda s: F.trim(s) != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits, and other characters one by one. (A rule of our own for a trained tokenizer.)"""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def n_long_words(text: Column) -> Column:
    """Tokens longer than two characters."""
    return F.size(F.filter(word_tokens(text), lambda w: F.length(w) > 2))


def citations(sentence: Column) -> Column:
    """Cited indices: ``[3]`` gives 3, repeats stay, ``[1, 2]`` is none."""
    found = F.regexp_extract_all(sentence, F.lit(CITATION), F.lit(0))
    return F.transform(found, lambda c: F.regexp_extract(c, r"\d+", 0).cast("int"))


def normalize(text: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not wherever (and as often as) a lambda inside mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_ngrams(text: Column, n: int) -> Column:
    """The ``n``-word sequences of the text, in order; none if it is shorter."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        count = F.size(w) - n + 1
        every = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(count > 0, every).otherwise(F.array().cast("array<string>"))

    return let(words, grams)


def question_id(path: Column) -> Column:
    """The stem of a file name, without ``_aggregated``."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), "_aggregated$", "")


def estimated_tokens(texts: Column) -> Column:
    """A quarter of the characters of an array of texts, rounded down."""
    return F.floor(F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.length(t)) / 4)


def formal_text(text: Column) -> Column:
    """Without thoughts, special tokens and tool tags; what follows a stray ``</think>``."""
    out = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"<[｜\|]?\s*[\|｜]?\s*[^>]*?[\|｜]\s*>", "")
    out = F.regexp_replace(out, r"(?i)</?tool_(?:call|response)[^>]*>", "")
    out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    tail = F.substring(out, F.locate("</think>", out) + len("</think>"), F.length(out))
    return F.when(F.locate("</think>", out) > 0, F.regexp_replace(tail, r"^\n+", "")).otherwise(out)


def remove_thought(text: Column, words: tuple[str, str] = ("<think>", "</think>")) -> Column:
    pattern = rf"(?s)\Q{words[0]}\E.*?\Q{words[1]}\E"
    return F.regexp_replace(F.regexp_replace(text, pattern, ""), r"^\n+", "")


def add_thought(text: Column, words: tuple[str, str] = ("<think>", "</think>")) -> Column:
    return F.concat(F.lit(f"{words[0]}\n\n{words[1]}\n\n"), text)


def extract_code(text: Column, language: str = "python") -> Column:
    """The last fenced block of a language, or nothing."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)```{language}\n(.*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def json_between(text: Column, open_: str = "[", close: str = "]") -> Column:
    """From the first opening to the last closing delimiter, or null."""
    first = F.locate(open_, text)
    last = F.length(text) - F.locate(close, F.reverse(text)) + 1
    return F.when((first > 0) & (F.locate(close, text) > 0) & (last >= first), F.substring(text, first, last - first + 1))


def parse_rule_list(text: Column) -> Column:
    """An array of non-empty rules: the JSON list in the text, else its quoted strings."""
    inner = F.from_json(json_between(text), "array<string>")
    quoted = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.filter(F.coalesce(inner, quoted), lambda x: F.trim(x) != "")


def parameter_count(name: Column) -> Column:
    """The largest size in a model's name (``7b``, ``8x7B``, ``350m``) as a number, -1 if none."""
    found = F.regexp_extract_all(F.lower(name), F.lit(r"\d+(?:\.\d+)?(?:x\d+(?:\.\d+)?)?[bm]"), F.lit(0))

    def number(m: Column) -> Column:
        parts = F.transform(F.split(F.regexp_replace(m, "[bm]$", ""), "x"), lambda x: x.cast("double"))
        unit = F.when(m.endswith("b"), F.lit(1e9)).otherwise(F.lit(1e6))
        return F.aggregate(parts, F.lit(1.0), lambda a, x: a * x) * unit

    return F.coalesce(F.array_max(F.transform(found, number)), F.lit(-1.0)).cast("long")


def method_name(method: Column, dataset: Column, engine: Column) -> Column:
    """``{method}_{dataset}_{engine}``, the dataset in lower case with ``_`` for ``-`` and spaces."""
    return F.concat_ws("_", method, F.regexp_replace(F.lower(dataset), "[- ]", "_"), engine)


def parse_method_name(name: Column, methods: list[str]) -> Column:
    """method, dataset and engine of a name; the engine is its last part; ``methods`` are matched without regard to case, longer ones first. Null for another method."""
    low = F.lower(name)
    known = "|".join(rf"\Q{m.lower()}\E" for m in sorted(methods, key=len, reverse=True))
    method = F.regexp_extract(low, rf"^({known})(?:_|$)", 1)
    parts = F.split(low, "_")
    rest = F.substring(low, F.length(method) + 2, F.length(low))
    engine = F.try_element_at(parts, F.lit(-1))
    dataset = F.regexp_replace(F.substring(rest, F.lit(1), F.greatest(F.length(rest) - F.length(engine) - 1, F.lit(0))), "_", "-")
    return F.when(method != "", F.struct(method.alias("method"), dataset.alias("dataset"), engine.alias("engine")))


def support_weight(label: Column) -> Column:
    """Full, partial or no support as 1, 0.5 or 0; unknown labels count as none."""
    return F.coalesce(F.try_element_at(F.create_map(F.lit("full_support"), F.lit(1.0), F.lit("partial_support"), F.lit(0.5), F.lit("no_support"), F.lit(0.0)), label), F.lit(0.0))


# The phrases of a judge's feedback, in the order in which they count.
FEEDBACK = {"CE": "Compilation error", "MLE": "Memory limit exceeded", "TLE": "Time limit exceeded", "WA": "Output isn't correct"}


def verdict(score: Column, feedback: Column) -> Column:
    """A judge's verdict (CE, MLE, TLE, WA, RE, AC, PA): without points by a phrase of the feedback, as it is written; else by the score."""
    failed = F.coalesce(*(F.when(F.contains(feedback, F.lit(words)), code) for code, words in FEEDBACK.items()), F.lit("RE"))
    return F.when(score == 0.0, failed).when(score == 1.0, "AC").otherwise("PA")


# Headers that rewritten texts may begin with.
HEADERS = ("**Rewritten Source: **", "**Regenerated Source: **")


def without_headers(text: Column, headers: tuple[str, ...] = HEADERS) -> Column:
    for h in headers:
        text = F.replace(text, F.lit(h), F.lit(""))
    return text


def present(value: Column) -> Column:
    """Whether there is a text: neither null nor empty."""
    return value.isNotNull() & (value != "")


def rule_text(rules: Column) -> Column:
    return F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r)), "\n")


def trim_padding(ids: Column, pad: int, side: str = "left", eos: int | None = None) -> Column:
    """Without ``pad`` at one side; of nothing but padding one id stays, and one at the right end where padding is the end mark ``eos``."""
    size = F.size(ids)
    if side == "left":
        first = F.try_element_at(F.filter(F.transform(ids, lambda x, i: F.when(x != pad, i + 1)), lambda i: i.isNotNull()), F.lit(1))
        return F.when(first.isNull(), F.slice(ids, 1, 1)).otherwise(F.slice(ids, F.coalesce(first, F.lit(1)), F.greatest(size, F.lit(1))))
    last = F.array_max(F.transform(ids, lambda x, i: F.when(x != pad, i + 1)))
    more = F.when(last.isNotNull(), F.lit(1)).otherwise(0) if eos == pad else F.lit(0)
    return F.slice(ids, F.lit(1), F.coalesce(last, F.lit(1)) + more)
