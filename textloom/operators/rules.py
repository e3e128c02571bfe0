"""Preference rules: prompts, parsing of answers, distinct rules, merging by levels."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, rule_text
from ..shared import table
from .folds import greedy_runs

#: Estimated tokens are a quarter of the characters.
CHARS_PER_TOKEN = 4


def distinct_rules(rules: DataFrame, column: str = "rules") -> DataFrame:
    """(rule) once each, from rows that hold arrays of them."""
    return rules.select(F.explode_outer(column).alias("rule")).where(F.trim("rule") != "").distinct()


def repair_json(text: str) -> str:
    """A JSON list of strings out of an answer: code fences go, the part from the first ``[`` to the last ``]`` stays, and quotes inside strings are escaped.

    A quote ends a string if what follows it, but for spaces, is a comma, a bracket or the end.
    """
    text = text.replace("```json", "").replace("```", "").strip()
    a, z = text.find("["), text.rfind("]")
    if a < 0 or z < a:
        return text
    text = text[a : z + 1]
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\" and i + 1 < len(text):
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            if not inside:
                inside = True
            else:
                rest = text[i + 1 :].lstrip()
                if not rest or rest[0] in ",]":
                    inside = False
                else:
                    c = '\\"'
        elif inside and c == "\n":
            c = "\\n"
        out.append(c)
        i += 1
    return "".join(out)


def parsed_rules(answers: DataFrame, column: str = "answer", out: str = "rules") -> DataFrame:
    """Adds an array of rules: the repaired JSON list, or else the quoted strings of the answer."""
    import re

    def parse(batches):
        for b in batches:
            found = []
            for t in b[column].fillna(""):
                try:
                    x = json.loads(repair_json(t))
                    x = x if isinstance(x, list) else []
                except ValueError:
                    x = re.findall(r'"((?:[^"\\]|\\.)*)"', t)
                found.append([r.strip() for r in x if isinstance(r, str) and r.strip()])
            yield b.assign(**{out: found})

    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    return answers.mapInPandas(parse, StructType([*answers.schema.fields, StructField(out, ArrayType(StringType()))]))


def greedy_chunks(rules: DataFrame, budget: int = 20_000) -> DataFrame:
    """(chunk, rules): consecutive rules in their order, as many as the budget of estimated tokens allows; one that is too long is alone.

    One fold over all rules, however many (:func:`~.folds.greedy_runs`).
    """
    sized = rules.select("rule", F.floor(F.length("rule") / CHARS_PER_TOKEN).alias("tokens"))
    runs = greedy_runs(sized, ["rule"], "tokens", budget, "chunk")
    return runs.groupBy("chunk").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def merge_rules(rules: DataFrame, merge: Callable[[DataFrame], DataFrame], budget: int = 20_000) -> DataFrame:
    """(rule): chunks are merged, the results made distinct, and again until they fit one chunk, which is merged last.

    merge: (chunk, rules) to (chunk, rules), e.g. a scorer over prompts. After a level that leaves as many characters as it took or
    more, chunks have twice the budget, so that rules far apart in order meet, however often that takes: at last all are in one
    chunk. (So rules that a merger keeps apart must fit a task; with a merger that shortens every level no row holds more than the budget.)
    """
    rules = distinct_rules(rules.select(F.array("rule").alias("rules"))) if "rules" not in rules.columns else distinct_rules(rules)
    rules = table(rules, "rules")
    room, chars = budget, _characters(rules)
    while chars // CHARS_PER_TOKEN > room:
        rules = table(distinct_rules(merge(greedy_chunks(rules, room))), "rules")
        before, chars = chars, _characters(rules)
        room = room * 2 if chars >= before else room
    whole = rules.agg(F.array_sort(F.collect_list("rule")).alias("rules")).select(F.lit(0).cast("long").alias("chunk"), "rules")
    return distinct_rules(merge(whole.where(F.size("rules") > 0)))


def _characters(rules: DataFrame) -> int:
    return rules.agg(F.coalesce(F.sum(F.length("rule")), F.lit(0))).first()[0]


def keep_first_words(chunks: DataFrame, words: int = 3) -> DataFrame:
    """A stand-in for a merger: of the rules that begin with the same words the first stays."""
    begin = lambda r: F.array_join(F.slice(F.split(F.lower(r), " "), 1, words), " ")
    first = lambda h: F.filter("rules", lambda r, i: F.array_position(h, F.get(h, i)) == i + 1)
    return chunks.select("chunk", let(F.transform("rules", begin), first).alias("rules"))


def rewrite_prompt(document: Column, rules: Column) -> Column:
    """The prompt to rewrite a document by rules."""
    return F.concat(F.lit("Rewrite the document so that it follows the rules below, and keep its facts.\n\n## Document\n"), document, F.lit("\n\n## Rules\n"), rule_text(rules))


def explain_prompt(query: Column, a: Column, b: Column, winner: Column) -> Column:
    return F.concat(F.lit("Question: "), query, F.lit("\n\nDocument A:\n"), a, F.lit("\n\nDocument B:\n"), b, F.lit("\n\nAn answer drew more on document "), winner, F.lit(". Explain which of its properties made it so."))


def extract_prompt(explanation: Column) -> Column:
    return F.concat(F.lit("From the explanation below, state general rules for documents as a JSON list of strings.\n\n"), explanation)


def merge_prompt(rules: Column) -> Column:
    return F.concat(F.lit("Some of the rules below say the same. Merge these, keep all others, and answer with a JSON list of strings.\n\n"), rule_text(rules))


def filter_prompt(rules: Column) -> Column:
    return F.concat(F.lit("Which of the rules below can a writer follow in any document? Answer with these alone, as a JSON list of strings.\n\n"), rule_text(rules))


def claims_prompt(answer: Column) -> Column:
    return F.concat(F.lit("List the claims of the answer below with the numbers of the sources that it cites for each, as JSON: [{\"claim\": ..., \"sources\": [...]}]\n\n"), answer)


def support_prompt(claim: Column, document: Column) -> Column:
    return F.concat(F.lit("Does the source support the claim? Answer full_support, partial_support or no_support.\n\nClaim: "), claim, F.lit("\n\nSource:\n"), document)


def rating_prompt(criterion: Column, question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Rate the answer from 0 to 10 for its "), F.lower(criterion), F.lit(".\n\nQuestion: "), question, F.lit("\n\nAnswer:\n"), answer)


def points_prompt(points: Column, answer: Column) -> Column:
    """points: array<struct<point_number, point_content>>."""
    lines = F.array_join(F.transform(points, lambda p: F.concat(p["point_number"].cast("string"), F.lit(". "), p["point_content"])), "\n")
    return F.concat(F.lit("For each point say whether the answer has it: Supported, Omitted or Contradicted, as JSON by number.\n\nPoints:\n"), lines, F.lit("\n\nAnswer:\n"), answer)


def default_rules(rows: DataFrame, rules: DataFrame, fallback: str) -> DataFrame:
    """Adds rules by dataset and engine (its name contains the rule set's), else the fallback set's."""
    some = rules.select(F.col("dataset").alias("_d"), F.col("engine").alias("_e"), F.col("rules").alias("_r"), "name")
    found = rows.join(some, (F.lower(F.col("dataset")) == F.lower("_d")) & F.lower(F.col("engine")).contains(F.lower("_e")), "left")
    base = some.where(F.col("name") == fallback).select(F.col("_r").alias("_base"))
    return found.join(base.limit(1), F.lit(True), "left").withColumn("rules", F.coalesce("_r", "_base")).drop("_d", "_e", "_r", "_base", "name")
